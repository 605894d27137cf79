"""Hand-written pages of many layouts, kept apart from the trainer's. What is article text stands between ⟦ and ⟧."""

P1 = "⟦The river rose again on Tuesday night, and the town council met at seven to decide whether the lower streets should be cleared before morning.⟧"
P2 = "⟦Most of the families had already left, taking the road over the hill, while a few stayed behind to move furniture to the upper floors.⟧"
P3 = "⟦By noon the water had begun to fall. Engineers said the new wall had held, although two pumps will have to be replaced this week.⟧"
F1 = "⟦Le conseil municipal a voté hier soir le budget de l'année prochaine, après un débat qui a duré plus de quatre heures.⟧"
F2 = "⟦Les travaux de la bibliothèque commenceront au printemps ; le chantier doit durer dix-huit mois, selon l'architecte.⟧"
D1 = "⟦Die Stadtwerke haben am Montag mit dem Austausch der alten Leitungen begonnen, der bis zum Herbst dauern soll.⟧"
S1 = "⟦El museo abrirá sus puertas el sábado con una exposición dedicada a los pintores de la región durante el siglo pasado.⟧"

PAGES = {
    "div paragraphs": f"<html><body><div class='site'><div class='logo'>The Valley Post</div><div class='story'><h1>⟦Flood wall holds⟧</h1><div>{P1}</div><div>{P2}</div><div>{P3}</div></div><div class='footer'>All rights reserved.</div></div></body></html>",
    "one paragraph": f"<p>{P1}</p>",
    "plain text": f"{P1} {P2}",
    "cookie banner": f"<body><div class='cookie-banner'><p>We use cookies to make this site work better for you.</p><button>Accept all</button></div><article><h1>⟦Water falls⟧</h1><p>{P1}</p><p>{P3}</p></article></body>",
    "figure": f"<main><h2>⟦A night on the river⟧</h2><p>{P1}</p><figure><img src='r.jpg'><figcaption>⟦Volunteers fill sandbags near the old bridge on Tuesday.⟧</figcaption></figure><p>{P2}</p><p>⟦Nobody was hurt.⟧</p></main>",
    "table layout": f"<table width='100%'><tr><td><a href='/'>Home</a><br><a href='/n'>News</a><br><a href='/c'>Contact</a></td><td><font size='5'>⟦Flood wall holds⟧</font><p>{P1}</p><p>{P2}</p></td></tr></table>",
    "breaks only": f"<body><center><b>The Valley Post</b></center><hr><div id='text'>{P1}<br><br>{P2}<br><br>{P3}</div><hr><small>Copyright 1999 The Valley Post</small></body>",
    "nav and sidebar": f"<header class='top'><nav><ul><li><a href='/'>Home</a></li><li><a href='/s'>Sport</a></li><li><a href='/w'>Weather</a></li></ul></nav></header><div class='row'><div class='col-8'><h1>⟦Council meets⟧</h1><p>{P1}</p><p>{P2}</p></div><div class='sidebar'><h3>Most read</h3><ul><li><a href='/1'>Ten tips for a dry cellar</a></li><li><a href='/2'>Bridge to close in May</a></li></ul></div></div><footer><p>Privacy policy</p><p>Terms of use</p></footer>",
    "comments": f"<article><h1>⟦Flood wall holds⟧</h1><p>{P1}</p><p>{P3}</p></article><section id='comments'><h3>2 comments</h3><div class='comment'><b>anna</b><p>I was there all night and nobody from the council came to our street.</p></div><div class='comment'><b>ben</b><p>Thank you to all the volunteers who carried the sandbags.</p></div><form><textarea></textarea><button>Send</button></form></section>",
    "share and tags": f"<div class='post'><h1>⟦Flood wall holds⟧</h1><p>{P1}</p><p>{P2}</p><div class='share-buttons'><a href='#'>Share</a> <a href='#'>Tweet</a></div><ul class='tags'><li><a href='/t/flood'>flood</a></li><li><a href='/t/river'>river</a></li></ul></div>",
    "advert inside": f"<div class='article-body'><p>{P1}</p><div class='ad-container'><p>Advertisement</p><p>Save 20 percent on boots this weekend only!</p></div><p>{P2}</p><p>{P3}</p></div>",
    "newsletter box": f"<article><p>{P1}</p><div class='newsletter-box'><h4>Sign up for our newsletter</h4><p>Get the best stories of the week in your inbox.</p><input><button>Subscribe</button></div><p>{P3}</p></article>",
    "recipe": "<main><h1>⟦Lentil soup⟧</h1><p>⟦A quick soup for cold evenings, from what is in the cupboard.⟧</p><h2>⟦Ingredients⟧</h2><ul><li>⟦200 g red lentils⟧</li><li>⟦1 onion⟧</li><li>⟦1 litre of stock⟧</li></ul><h2>⟦Method⟧</h2><ol><li>⟦Fry the onion in a little oil until it is soft.⟧</li><li>⟦Add lentils and stock and cook for twenty minutes.⟧</li></ol></main><footer>© Kitchen notes</footer>",
    "data table": f"<div id='content'><h1>⟦Rainfall by month⟧</h1><p>{P3}</p><table><tr><th>⟦Month⟧</th><th>⟦Millimetres⟧</th></tr><tr><td>⟦March⟧</td><td>⟦81⟧</td></tr><tr><td>⟦April⟧</td><td>⟦64⟧</td></tr></table></div><div id='menu'><a href='/'>Start</a> <a href='/data'>Data</a></div>",
    "quote": f"<article><p>{P1}</p><blockquote><p>⟦We did not sleep, but we kept the water out of the school.⟧</p></blockquote><p>{P2}</p></article><div class='related-posts'><h3>Related articles</h3><a href='/a'>How the wall was built</a></div>",
    "french": f"<body><div id='entete'>Le Courrier de la Vallée</div><nav><a href='/'>Accueil</a> <a href='/actu'>Actualités</a></nav><div class='contenu'><h1>⟦Le budget est voté⟧</h1><p>{F1}</p><p>{F2}</p></div><footer>Mentions légales</footer></body>",
    "german": f"<body><ul class='nav'><li><a href='/'>Startseite</a></li><li><a href='/k'>Kontakt</a></li></ul><section class='artikel'><h2>⟦Neue Leitungen⟧</h2><p>{D1}</p></section><div id='footer'>Impressum</div></body>",
    "spanish": f"<body><div class='aviso-cookies'>Utilizamos cookies propias y de terceros. <a href='#'>Aceptar</a></div><main><h1>⟦Abre el museo⟧</h1><p>{S1}</p></main></body>",
    "links within": f"<article><p>⟦The report, <a href='/r'>published on Monday</a>, says that the wall was built in <a href='/w'>two years</a> and cost less than planned.⟧</p><p>{P2}</p></article><div class='breadcrumbs'><a href='/'>Home</a> &gt; <a href='/n'>News</a></div>",
    "login form": f"<div class='header'><form><label>Username</label><input><label>Password</label><input><button>Log in</button></form></div><div class='entry-content'><p>{P1}</p><p>{P2}</p></div>",
    "camel case names": f"<div class='pageWrapper'><div class='mainNav'><a href='/'>Home</a><a href='/x'>Shop</a></div><div class='articleBody'><p>{P1}</p><p>{P3}</p></div><div class='cookieNotice'>This site uses cookies.</div></div>",
    "unknown names": f"<div class='x1'><div class='k9'><a href='/'>Home</a> | <a href='/b'>Blog</a></div><div class='z3'><h1>⟦Flood wall holds⟧</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></div>",
    "sections": f"<main><section><h2>⟦What happened⟧</h2><p>{P1}</p></section><section><h2>⟦What is next⟧</h2><p>{P3}</p></section></main><aside class='widget'><p>Follow us</p></aside>",
    "definition list": f"<div class='content'><h1>⟦Words of the river⟧</h1><dl><dt>⟦Weir⟧</dt><dd>⟦A low wall across a river that holds the water back.⟧</dd><dt>⟦Spate⟧</dt><dd>⟦A sudden rise of the water after heavy rain.⟧</dd></dl></div><footer>Back to top</footer>",
    "preformatted": f"<body><h1>⟦Notes on pumps⟧</h1><p>{P3}</p><pre>⟦pump 1: 40 litres a second\npump 2: 35 litres a second⟧</pre></body>",
    "popup first": f"<div class='modal'><p>Subscribe to our newsletter and never miss a story.</p><button>Close</button></div><div class='wrapper'><article class='post'><h1>⟦Flood wall holds⟧</h1><p>{P1}</p><p>{P2}</p></article></div>",
    "long article": "<article><h1>⟦A year by the river⟧</h1>" + "".join(f"<p>{p}</p>" for p in (P1, P2, P3) * 6) + "</article><footer>© The Valley Post</footer>",
    "no article": "<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li><li><a href='/c'>Contact</a></li></ul></nav><form><label>Search</label><input><button>Search</button></form><footer>All rights reserved.</footer></body>",
    "cookie page only": "<body><div class='cookie-notice'><p>We use cookies. By continuing you agree to our policy.</p><button>OK</button></div><footer><a href='/p'>Privacy policy</a></footer></body>",
    "unclosed": f"<body><div class=menu><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div class=post><h1>⟦Flood wall holds⟧</h1><p>{P1}<p>{P2}<p>{P3}</div><div class=footer>Terms of use",
    "script and noscript": f"<head><title>x</title><script>var a='<p>no</p>';</script></head><body><noscript>Please enable JavaScript.</noscript><main><p>{P1}</p><p>{P2}</p></main><script>track()</script></body>",
    "two columns": f"<div id='left'><h4>Categories</h4><ul><li><a href='/1'>Local</a></li><li><a href='/2'>World</a></li></ul></div><div id='right'><h2>⟦Council meets⟧</h2><p>{P1}</p><p>{P2}</p></div><div id='bottom'>Powered by a content system</div>",
}
