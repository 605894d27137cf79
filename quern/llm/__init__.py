"""Training-data operators: quality, packing, chat formatting, search, deduplication, licences, mixing, language and HTML."""
