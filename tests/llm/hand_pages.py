"""Pages written by hand, with their main text: (what it shows, html, text)."""

A = "The ferry left the harbour before dawn, with half of its lamps out and most of its passengers asleep on the benches."
B = "Nobody on the island had asked for a bridge, but the council had drawn one all the same, and then paid for it twice."
C = "In the end it was the baker who put the question, quietly, while the minister was still looking for his glasses."
D = "What the engineers found under the second pillar was not rock at all, but the hull of a ship that nobody had missed."
E = "The report ran to four hundred pages; its last line said that no one should read it without a map and a strong coffee."
F = "Winter came early that year, and the workers went home with their tools wrapped in newspapers against the salt."
G = "By spring there were gulls nesting on the crane, and the contract forbade moving them before the end of August."
H = "So the bridge stands as it stood then, a third of the way to somewhere, and the ferry still leaves before dawn."
ALL = [A, B, C, D, E, F, G, H]
PARAS = "".join(f"<p>{x}</p>" for x in ALL)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 The Island Post. All rights reserved.</footer>"
ITEMS = [f"{w} on the island" for w in ("Harbour", "Bakery", "School", "Chapel", "Lighthouse", "Market", "Library", "Station", "Museum", "Mill", "Garden", "Quarry")]
LINKED = "<ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(ITEMS)) + "</ul>"


def lines(*parts: str) -> str:
    return "\n".join(parts)


PAGES = [
    ("bare body", f"<html><body><h1>The bridge to nowhere</h1>{PARAS}</body></html>", lines("The bridge to nowhere", *ALL)),
    ("bare body with a menu and a footer", f"<html><body>{NAV}<h1>The bridge to nowhere</h1>{PARAS}{FOOT}</body></html>", lines("The bridge to nowhere", *ALL)),
    ("fragment of two paragraphs", f"<p>{A}</p><p>{B}</p>", lines(A, B)),
    ("fragment of one paragraph", f"<p>{C}</p>", C),
    ("fragment with a heading", f"<h2>Part two</h2><p>{A}</p><p>{D}</p><p>{E}</p>", lines("Part two", A, D, E)),
    ("text without elements", f"{A}<br><br>{B}", f"{A} {B}"),
    ("div with a class that says nothing", f'<html><body><div class="x3"><p>{A}</p><p>{B}</p><p>{C}</p></div></body></html>', lines(A, B, C)),
    ("text right in a div with a class that says nothing", f'<body><div class="x3">{A} {B}</div></body>', f"{A} {B}"),
    ("div without attributes", f"<body>{NAV}<div><h1>Bridge</h1>{PARAS}</div>{FOOT}</body>", lines("Bridge", *ALL)),
    ("divs in divs", f'<body><div id="a1"><div class="q"><div><h1>Bridge</h1><div>{A}</div><div>{B}</div><div>{C}</div></div></div></div></body>', lines("Bridge", A, B, C)),
    ("short link paragraph between two", f"<body><article><h1>Bridge</h1><p>{A}</p><p>See <a href=/x>this page about it</a>.</p><p>{B}</p></article></body>", lines("Bridge", A, "See this page about it.", B)),
    ("link paragraph in a bare body", f"<body><h1>Bridge</h1><p>{A}</p><p><a href=/m>The minutes of the council</a></p><p>{B}</p><p>{C}</p></body>", lines("Bridge", A, "The minutes of the council", B, C)),
    ("article that is a list of links", f"<body>{NAV}<article><h1>Places to see</h1>{LINKED}</article>{FOOT}</body>", lines("Places to see", *ITEMS)),
    ("main that is a list of links", f"<body>{NAV}<main><h1>Places to see</h1><p>{A}</p>{LINKED}</main>{FOOT}</body>", lines("Places to see", A, *ITEMS)),
    ("list of links with words after each", "<body><article><h1>Reading</h1><ol>" + "".join(f'<li><a href="/{i}">{x}</a> {B}</li>' for i, x in enumerate(ITEMS[:5])) + "</ol></article></body>", lines("Reading", *[f"{x} {B}" for x in ITEMS[:5]])),
    ("long quotation", f"<body><article><h1>The speech</h1><p>{A}</p><blockquote>{PARAS}{PARAS}</blockquote><p>{B}</p></article></body>", lines("The speech", A, *ALL, *ALL, B)),
    ("quotation in a bare body", f"<body><h1>The speech</h1><blockquote><p>{A}</p><p>{B}</p><p>{C}</p></blockquote><p>{D}</p></body>", lines("The speech", A, B, C, D)),
    ("table layout", f"<body><table><tr><td><nav><a href=/>Home</a> <a href=/n>News</a></nav></td><td><h1>Bridge</h1>{PARAS}</td></tr></table></body>", lines("Bridge", *ALL)),
    ("table layout without a menu", f"<body><table><tr><td><h1>Bridge</h1><p>{A}</p><p>{B}</p></td></tr></table></body>", lines("Bridge", A, B)),
    ("table of data", f"<body><article><h1>Tides</h1><p>{A}</p><table><tr><td>Monday</td><td>04:10</td></tr><tr><td>Tuesday</td><td>05:02</td></tr></table><p>{B}</p></article></body>", lines("Tides", A, "Monday", "04:10", "Tuesday", "05:02", B)),
    ("heading levels", f"<body><div><h1>Bridge</h1><h2>Before</h2><p>{A}</p><h2>After</h2><p>{B}</p><h3>Later</h3><p>{C}</p></div></body>", lines("Bridge", "Before", A, "After", B, "Later", C)),
    ("advert inside", f'<body><article><h1>Bridge</h1><p>{A}</p><div class="advert">Buy a boat today, only three left.</div><p>{B}</p><p>{C}</p></article></body>', lines("Bridge", A, B, C)),
    ("comments behind", f'<body><div><h1>Bridge</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><section class="comments"><h3>2 comments</h3><div class="comment"><p>I never liked that bridge, and I said so then.</p></div><div class="comment"><p>Nor did I.</p></div></section></body>', lines("Bridge", A, B, C)),
    ("cookie notice and sidebar", f'<body><div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>OK</button></div><div class="c12"><h1>Bridge</h1>{PARAS}</div><aside><h3>Most read</h3><ul><li><a href=/1>A whale at the pier</a></li><li><a href=/2>Bread prices rise</a></li></ul></aside></body>', lines("Bridge", *ALL)),
    ("menu and search form in divs", f'<body><div class="main-menu"><a href=/>Home</a> <a href=/n>News</a> <a href=/a>About</a></div><form class="search"><label>Search the site</label><input name=q></form><div><p>{A}</p><p>{B}</p><p>{C}</p></div></body>', lines(A, B, C)),
    ("only a menu and a footer", f"<body>{NAV}{FOOT}</body>", ""),
    ("preformatted text", f"<body><article><h1>Log</h1><p>{A}</p><pre>start  engine\nstop   engine</pre></article></body>", lines("Log", A, "start engine stop engine")),
    ("definitions", f"<body><article><h1>Words</h1><dl><dt>Ferry</dt><dd>{A}</dd><dt>Bridge</dt><dd>{B}</dd></dl></article></body>", lines("Words", "Ferry", A, "Bridge", B)),
    ("formula in a line", f"<body><article><h1>Load</h1><p>{A} So <math><mi>f</mi><mo>=</mo><mn>2</mn><mi>m</mi></math> holds.</p><p>{B}</p></article></body>", lines("Load", f"{A} So f=2m holds.", B)),
    ("site header, breadcrumbs, share bar", f'<body><header class="site-header"><a href=/>The Island Post</a></header><div class="breadcrumbs"><span><a href=/>Home</a></span><span><a href=/n>News</a></span></div><div class="k7"><h1>Bridge</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></div><ul class="share"><li><a href=/t>Tell a friend</a></li></ul>{FOOT}</body>', lines("Bridge", A, B, C, D)),
    ("sections with ids", f'<body><div id="wrapper"><section id="s-1"><h2>One</h2><p>{A}</p></section><section id="s-2"><h2>Two</h2><p>{B}</p></section></div></body>', lines("One", A, "Two", B)),
    ("Cyrillic", "<body><h1>Мост</h1><p>Паром ушёл из гавани до рассвета, и почти все пассажиры спали на скамьях у окна.</p><p>Никто на острове не просил о мосте, но совет всё же начертил его.</p></body>", lines("Мост", "Паром ушёл из гавани до рассвета, и почти все пассажиры спали на скамьях у окна.", "Никто на острове не просил о мосте, но совет всё же начертил его.")),
    ("short article", f"<body>{NAV}<article><h1>Closed</h1><p>The ferry does not run today.</p></article>{FOOT}</body>", lines("Closed", "The ferry does not run today.")),
]
