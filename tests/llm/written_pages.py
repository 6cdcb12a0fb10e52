"""Pages written by hand: (html, the article's blocks)."""

A = "The city council met on Tuesday evening to discuss the new budget for schools and roads."
B = "Members of the public asked why the plan had been delayed, and the mayor promised an answer by June."
C = "In the end the vote was close: seven members were for it and six against."
D = "Der Stadtrat hat am Dienstag über den neuen Haushalt beraten, und die Sitzung dauerte bis in die Nacht."
E = "Le conseil municipal a voté le budget mardi soir, après un long débat sur les écoles et les routes."
F = "El ayuntamiento aprobó el presupuesto el martes por la noche, después de un largo debate sobre las escuelas."
G = "Mix the flour with two eggs, a little salt and half a cup of milk, then let it rest for an hour."
H = "Bake the dough at 200 degrees until it is golden, and serve it warm with butter."
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li><a href=/c>Contact</a></li></ul>"
LINKS = "<a href=/>Home</a> <a href=/a>About us</a> <a href=/c>Contact</a>"
FOOT = "<footer>&copy; 2024 The Daily Post. All rights reserved.</footer>"


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


PAGES = [
    (f"<body>{p(A, B)}</body>", [A, B]),
    (f"<body>{MENU}<div id=bodyContent>{p(A, B, C)}<div id=catlinks>Category: <a href=/b>Budgets</a></div></div>{FOOT}</body>", [A, B, C]),
    (f"<table><tr><td>{LINKS}</td><td>{p(A, B)}</td></tr></table>", [A, B]),
    (f"<nav>{MENU}</nav><article>{p(A)}<p><a href=/x>{B}</a></p>{p(C)}</article>{FOOT}", [A, B, C]),
    (f"<nav>{MENU}</nav><main><h1>Budget approved</h1>{p(A, B)}</main>{FOOT}", ["Budget approved", A, B]),
    (f"<div class=navbar>{LINKS}</div><div class=wrapper><div class=row><div class=post-content><h2>Budget</h2>{p(A, C)}</div></div></div>", ["Budget", A, C]),
    (f"<header><h1>The Daily Post</h1></header><article><h1>Vote</h1>{p(A)}<blockquote>{B}</blockquote>{p(C)}</article><aside><h3>Related articles</h3>{MENU}</aside>{FOOT}", ["Vote", A, B, C]),
    (f"<nav>{MENU}</nav><article>{p(D)}<ul><li>Schulen<li>Straßen<li>Parks</ul>{p(D)}</article><footer>Impressum Datenschutz</footer>", [D, "Schulen", "Straßen", "Parks", D]),
    (f"<div id=header><a href=/>Logo</a></div><div id=content>{p(E, E)}</div><div id=footer>Mentions légales</div>", [E, E]),
    (f"<div class=menu>{MENU}</div><section class=entry-content><h1>Presupuesto</h1>{p(F)}</section><div class=comments><h3>2 comments</h3><div class=comment><b>Ana</b> <p>Muy bien, por fin.</p></div></div>", ["Presupuesto", F]),
    (f"<body><div class=cookie-notice>We use cookies to improve this site. <button>OK</button></div><article>{p(A, B)}</article></body>", [A, B]),
    (f"<article>{p(A)}<div class=ad>Buy now: 50% off shoes</div>{p(B, C)}</article>", [A, B, C]),
    (f"<div><div><div>{p(A, B, C)}</div></div></div>{FOOT}", [A, B, C]),
    (f"<p>{LINKS}</p>{p(A, B, C)}<p>Copyright 2023 Example Inc. All rights reserved.</p>", [A, B, C]),
    (f"<nav>{MENU}</nav><main><article><h1>Pancakes</h1>{p(G)}<ol><li>Mix<li>Rest<li>Bake</ol>{p(H)}</article></main><form><label>Search</label><input name=q><button>Go</button></form>", ["Pancakes", G, "Mix", "Rest", "Bake", H]),
    (f"<table width=100%><tr><td colspan=2><h2>My Page</h2></td></tr><tr><td>{MENU}</td><td>{p(G, H)}</td></tr></table>", [G, H]),
    (f"<div id=nav>{LINKS}</div><div id=story_body><h1>Council</h1><p>{A}<p>{B}<p>{C}</div>", ["Council", A, B, C]),
    (f"<article><header><h1>Vote in council</h1></header>{p(A, B)}<footer>Filed under: <a href=/l>Local</a></footer></article>", ["Vote in council", A, B]),
    (f"<nav>{MENU}</nav><div role=main>{p(A)}<pre>x = 1\ny = 2</pre>{p(B)}</div>{FOOT}", [A, "x = 1 y = 2", B]),
    (f"<article>{p(A)}<figure><img src=a.jpg><figcaption>The mayor in June</figcaption></figure>{p(C)}</article><section class=related-posts><h3>You may also like</h3>{MENU}</section>", [A, "The mayor in June", C]),
    (f"<body><div class=container><div class=sidebar><h3>Recent posts</h3>{MENU}</div><div class=main-content><h1>News</h1>{p(A, B)}</div></div>{FOOT}</body>", ["News", A, B]),
    (f"<nav>{MENU}</nav><article>{p(A)}<h2>Background</h2>{p(B)}<h2>The vote</h2>{p(C)}</article>{FOOT}", [A, "Background", B, "The vote", C]),
    (f"<script>var x='<p>no</p>';</script><style>p{{}}</style><noscript>Enable JavaScript</noscript><article>{p('Fish &amp; chips cost &pound;9.', A)}</article>", ["Fish & chips cost £9.", A]),
    (f"<div class=top-menu>{LINKS}</div><div class=story>{p(A, B)}<div class=share>Share this Tweet Print</div></div>", [A, B]),
    (f"<main>{p(A, B)}<section class=comments><h2>Comments</h2><p>I do not agree with this at all, the roads are fine.</p><p>Neither do I.</p></section></main>", [A, B]),
    (f"<div class=breadcrumb><a href=/>Home</a> &gt; <a href=/n>News</a></div><article><h1>Budget</h1>{p(A, B, C)}</article>", ["Budget", A, B, C]),
    (f"<article>{p(A)}<table><tr><th>Year<th>Cost<tr><td>2023<td>4 million</table>{p(B)}</article>{FOOT}", [A, "Year", "Cost", "2023", "4 million", B]),
    (f"<div class=page><div class=banner>Subscribe to our newsletter</div><div class=text>{p(E)}<p>Texte <b>important</b> et <i>court</i>.</p></div></div>", [E, "Texte important et court."]),
    (f"<html><head><title>Budget - Post</title></head><body><header><nav>{MENU}</nav></header><div id=main><div class=post hentry><h1>Budget</h1>{p(A, B)}</div></div><div class=widget>Most read {MENU}</div>{FOOT}</body></html>", ["Budget", A, B]),
    (f"<div class=notice>This site is under maintenance tonight.</div><div class=article-text>{p(D, D)}</div><div class=copyright>© 2022 Verlag. Alle Rechte vorbehalten.</div>", [D, D]),
    (f"<body><h1>Pancakes</h1>{p(G, H)}<hr><p><a href=/>Home</a> | <a href=/p>Privacy policy</a></p></body>", ["Pancakes", G, H]),
    (f"<nav>{MENU}</nav><article><div><p>{A}</p><div><p>{B}</p></div></div><dl><dt>Mayor<dd>{C}</dl></article><div class=newsletter>Sign up for updates <form><input><button>Send</button></form></div>", [A, B, "Mayor", C]),
    ("<nav>" + MENU + "</nav><ul><li><a href=/1>First</a><li><a href=/2>Second</a></ul>" + FOOT, []),
]
