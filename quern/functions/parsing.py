"""Sequential parsers as Arrow UDFs: fuzzy quotes, broken JSON, certificate groups, skill lists, number words, greedy pages.

Each works row by row on its own text, in vectorised batches; everything that Column expressions can say is in text.py.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: Number words of two languages; those of them that a quote must hold; words of negation.
NUMBERS = {w: n for n, ws in enumerate("zero|one un une|two deux|three trois|four quatre|five cinq|six|seven sept|eight huit|nine neuf|ten dix|eleven onze|twelve douze|thirteen treize|fourteen quatorze|fifteen quinze|sixteen seize".split("|")) for w in ws.split()}
TENS = {"twenty": 20, "vingt": 20, "thirty": 30, "trente": 30, "forty": 40, "quarante": 40, "fifty": 50, "cinquante": 50, "sixty": 60, "soixante": 60, "hundred": 100, "cent": 100}
ANCHORS = frozenset("deux trois quatre cinq six sept huit neuf dix onze douze quinze vingt trente quarante cinquante cent mille two three four five seven eight nine ten twelve fifteen twenty thirty forty fifty hundred thousand".split())
DIGITS = frozenset("0123456789")
NEGATIONS = frozenset("ne n pas non sans aucun aucune jamais ni not no never without nor".split())


def quoted(quote: str | None, text: str | None, share: float = 0.85) -> bool:
    """A folded quote of three words or more is in a folded text: word for word, or without spaces where no number at an end goes on, or so that a
    window of the text holds at least `share` of its words in order, with every number of the quote, in digits or words, and no negation that the quote lacks."""
    want, have = (quote or "").split(), (text or "").split()
    if len(want) < 3:
        return False
    if f" {' '.join(want)} " in f" {' '.join(have)} ":
        return True
    glued, whole = "".join(want), "".join(have)
    before, behind = "(?<![0-9])" if glued[0] in DIGITS else "", "(?![0-9])" if glued[-1] in DIGITS else ""
    if glued in whole and re.search(before + re.escape(glued) + behind, whole):
        return True
    places: dict[str, list[int]] = {}
    for k, w in enumerate(have):
        places.setdefault(w, []).append(k)
    need = share * len(want)
    missable = len(want) - int(-(-need // 1))
    for first in range(missable + 1):  # the first word that is found is one of these
        for start in places.get(want[first], ()):
            at, hits, skipped = start, 1, []
            lost = list(want[:first])
            for w in want[first + 1 :]:
                k = next((p for p in range(at + 1, min(len(have), at + 4)) if have[p] == w), None)
                if k is None:
                    lost.append(w)
                else:
                    skipped += have[at + 1 : k]
                    at, hits = k, hits + 1
            if hits >= need and not any(w in ANCHORS or w in NEGATIONS or DIGITS.intersection(w) for w in lost) and not NEGATIONS.intersection(skipped):
                return True
    return False


def repaired(text: str | None) -> str | None:
    """The first complete JSON object of a reply, as compact JSON: fences and thoughts are skipped, commas before a closing bracket dropped."""
    text = re.sub(r"(?s)<think>.*?</think>|```(?:json)?", " ", text or "")
    for start in (m.start() for m in re.finditer(r"\{", text)):
        depth, inside, escaped = 0, False, False
        for k in range(start, len(text)):
            c = text[k]
            if inside:
                inside, escaped = (c != '"' or escaped), c == "\\" and not escaped
            elif c == '"':
                inside = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if not depth:
                    try:
                        return json.dumps(json.loads(re.sub(r",(\s*[}\]])", r"\1", text[start : k + 1])), ensure_ascii=False, separators=(",", ":"))
                    except ValueError:
                        break
    return None


def grouped(text: str | None, names: list[str]) -> list[list[str]]:
    """Certificates of a requirement: those joined by "or" or by a slash are one group, "and" and commas begin another."""
    pattern = re.compile(r"(?<![a-z0-9])(" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(?![a-z0-9])", re.I)
    out: list[list[str]] = []
    end = None
    for m in pattern.finditer(text or ""):
        between = None if end is None else text[end : m.start()].strip().lower()
        if between in ("or", "ou", "/", ", or", "or equivalent"):
            out[-1].append(m[1].lower())
        else:
            out.append([m[1].lower()])
        end = m.end()
    return out


def listed(text: str | None) -> list[str]:
    """Parts between commas and semicolons that stand outside brackets and numbers."""
    out, depth, part, text = [], 0, "", text or ""
    for k, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        number = c == "," and text[k - 1 : k].isdigit() and text[k + 1 : k + 2].isdigit()
        if c in ",;" and depth <= 0 and not number:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [p for p in [*out, part.strip()] if p]


def digits(text: str | None) -> str | None:
    """Number words, compounds too, as digits."""
    if text is None:
        return None
    out, total = [], None
    for token in re.findall(r"\w+|\W+", text):
        w = token.lower()
        if w in NUMBERS or w in TENS:
            value = NUMBERS.get(w, TENS.get(w))
            total = value if total is None else total * 100 if value == 100 else total + value
        elif total is not None and (w in ("-", " ", "and", "et") or not w.strip(" -")):
            continue
        else:
            if total is not None:
                out.append(f"{total} " if token[0].isalnum() else str(total))
                total = None
            out.append(token)
    return "".join(out) + (str(total) if total is not None else "")


def filled(heights: list[int] | None, room: int) -> list[int]:
    """Page of each block when pages are filled in order."""
    page, used, out = 0, 0, []
    for h in heights or []:
        if used and used + h > room:
            page, used = page + 1, 0
        used += h
        out.append(page)
    return out


def walked(text: str | None) -> list[dict]:
    """path and value of every leaf of a JSON text, in order: keys joined by dots, list places left out, prefixes of names dropped. Broken JSON has none."""
    try:
        todo = [("", json.loads(text or ""))]
    except ValueError:
        return []
    out = []
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k.rsplit(':', 1)[-1]}".lstrip("."), v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(path, v) for v in reversed(value)]
        elif value is not None and str(value).strip():
            out.append({"path": path, "value": str(value).strip()})
    return out


json_leaves = F.pandas_udf(lambda t: t.map(walked), ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())])))
quote_in_text = F.pandas_udf(lambda q, t: pd.Series([quoted(a, b) for a, b in zip(q, t, strict=True)]), BooleanType())
repair_json = F.pandas_udf(lambda t: t.map(repaired), StringType())
split_list = F.pandas_udf(lambda t: t.map(listed), ArrayType(StringType()))
number_words = F.pandas_udf(lambda t: t.map(digits), StringType())


def certificate_groups(names: list[str]):
    return F.pandas_udf(lambda t: t.map(lambda x: grouped(x, names)), ArrayType(ArrayType(StringType())))


def fill_pages(room: int):
    return F.pandas_udf(lambda h: h.map(lambda x: filled(None if x is None else list(x), room)), ArrayType(IntegerType()))
