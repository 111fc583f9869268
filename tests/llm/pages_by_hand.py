"""Pages written by hand, each with its main text. No labeller was trained on them, and no generator made them."""

_FOOT = "<footer><p>© 2021 Lakeside Weekly</p><a href=/imprint>Imprint</a></footer>"
_MENU = "<nav><a href=/>Home</a> <a href=/news>News</a> <a href=/sport>Sport</a> <a href=/contact>Contact</a></nav>"

A = "The council met on Tuesday to discuss the new bridge over the canal."
B = "Costs have risen by a third since last year, and two members asked for a delay."
C = "A vote is expected in March, after the engineers have handed in their report."
T = "Bridge plan goes to a vote"
TEXT = f"{T}\n{A}\n{B}\n{C}"
BODY = f"<h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p>"


def page(inner: str, head: str = "<title>x</title>") -> str:
    return f"<!doctype html><html><head>{head}</head><body>{inner}</body></html>"


PAGES: list[tuple[str, str]] = [
    (page(f"{_MENU}<article>{BODY}</article>{_FOOT}"), TEXT),
    (page(f"{_MENU}<main>{BODY}</main>{_FOOT}"), TEXT),
    (page(f'{_MENU}<div class="c1">{BODY}</div>{_FOOT}'), TEXT),
    (page(f'{_MENU}<div id="mw-content-text"><div class="mw-parser-output">{BODY}</div></div>{_FOOT}'), TEXT),
    (page(f"<div>{BODY}</div>"), TEXT),
    (page(BODY), TEXT),
    (page(f'<div id="hd"><a href=/>Lakeside Weekly</a></div><div id="bd">{BODY}</div><div id="ft">Copyright 2021. All rights reserved.</div>'), TEXT),
    (page(f"<table><tr><td><a href=/>Home</a><br><a href=/a>Archive</a></td><td>{BODY}</td></tr></table>"), TEXT),
    (page(f"<table width=100%><tr><td>{BODY}</td></tr></table>{_FOOT}"), TEXT),
    (page(f'<header class="masthead"><a href=/>The Weekly</a></header>{_MENU}<div class="entry-content">{BODY}</div><div class="comments"><h3>2 comments</h3><p>Anna says:</p><p>I like the old bridge.</p></div>'), TEXT),
    (page(f'<div class="cookie-banner">This site uses cookies. <button>Accept</button></div>{_MENU}<article>{BODY}</article>'), TEXT),
    (page(f'<div class="css-1q2w3e"><p>We use cookies to improve your visit.</p></div><div class="css-9z8y7x">{BODY}</div>'), TEXT),
    (page(f'{_MENU}<section class="story">{BODY}</section><aside><h3>Related</h3><ul><li><a href=/1>Old canal</a></li><li><a href=/2>New mayor</a></li></ul></aside>{_FOOT}'), TEXT),
    (page(f'<article><h1>{T}</h1><p>{A}</p><div class="ad">Advertisement: fly to the sun for less.</div><p>{B}</p><p>{C}</p></article>'), TEXT),
    (page(f'<article><h1>{T}</h1><p>{A}</p><div class="newsletter-signup"><p>Subscribe</p><form><input><button>Send</button></form></div><p>{B}</p><p>{C}</p></article>'), TEXT),
    (page(f'<article><header><h1>{T}</h1></header><p>{A}</p><h2>What it costs</h2><p>{B}</p><p>{C}</p></article>{_FOOT}'), f"{T}\n{A}\nWhat it costs\n{B}\n{C}"),
    (page(f"<article><h1>{T}</h1><p>{A}</p><ul><li>The bridge is forty metres long.</li><li>It will carry trams.</li></ul><p>{C}</p></article>{_FOOT}"), f"{T}\n{A}\nThe bridge is forty metres long.\nIt will carry trams.\n{C}"),
    (page(f"<article><h1>{T}</h1><p>{A}</p><blockquote>We cannot wait for ever, said the mayor.</blockquote><p>{C}</p></article>"), f"{T}\n{A}\nWe cannot wait for ever, said the mayor.\n{C}"),
    (page(f"{_MENU}<div><h1>{T}</h1><div>{A}</div><div>{B}</div><div>{C}</div></div>{_FOOT}"), TEXT),
    (page(f"<article><h1>{T}</h1><p>{A}</p><table><tr><th>Year</th><th>Cost</th></tr><tr><td>2020</td><td>12 million</td></tr></table><p>{C}</p></article>{_FOOT}"), f"{T}\n{A}\nYear\nCost\n2020\n12 million\n{C}"),
    (page(f'<article><h1>{T}</h1><figure><img src=a.jpg><figcaption>The old bridge seen from the east.</figcaption></figure><p>{A}</p><p>{B}</p></article>'), f"{T}\nThe old bridge seen from the east.\n{A}\n{B}"),
    (page(f'<article><h1>{T}</h1><p>{A}</p><p>{B} See also <a href=/x>the first plan</a> of 2015.</p></article><div class="share">Share Tweet</div>'), f"{T}\n{A}\n{B} See also the first plan of 2015."),
    (page(f'{_MENU}<form action=/search><label>Search</label><input></form><div class="row"><div class="col-8">{BODY}</div><div class="col-4"><h4>Most read</h4><ul><li><a href=/1>Snow in May</a></li><li><a href=/2>Trams late</a></li></ul></div></div>{_FOOT}'), TEXT),
    (page(f'<div class="wrap"><div class="inner">{BODY}</div></div><div class="legal">Terms of use · Privacy policy</div>'), TEXT),
    (page(f"<article><h1>{T}</h1>" + "".join(f"<p>{A} {B}</p>" for _ in range(40)) + f"</article>{_FOOT}"), "\n".join([T] + [f"{A} {B}"] * 40)),
    (page(f"<nav><ul><li><a href=/>Start</a></li><li><a href=/k>Kontakt</a></li></ul></nav><article><h1>Die Brücke</h1><p>Der Rat hat am Dienstag über die neue Brücke gesprochen.</p><p>Im März soll abgestimmt werden.</p></article><footer>Alle Rechte vorbehalten.</footer>"), "Die Brücke\nDer Rat hat am Dienstag über die neue Brücke gesprochen.\nIm März soll abgestimmt werden."),
    (page('<div class="c7"><h1>Le pont</h1><p>Le conseil a parlé du nouveau pont mardi soir.</p><p>Le vote aura lieu en mars, après le rapport.</p></div><div class="c9"><a href=/m>Mentions légales</a> <a href=/c>Contact</a></div>'), "Le pont\nLe conseil a parlé du nouveau pont mardi soir.\nLe vote aura lieu en mars, après le rapport."),
    (page(f"{_MENU}<h1>{T}</h1><p>{A}</p><hr><p>{B}</p><p>{C}</p><hr><p>Copyright 2021 Lakeside Weekly</p>"), TEXT),
    (page(f"{_MENU}{_FOOT}"), ""),
    (page('<div class="login"><h2>Log in</h2><form><p>Password</p><button>Send</button></form></div>'), ""),
    (page(f'<div role="navigation"><a href=/>Home</a> | <a href=/b>Blog</a></div><div role="main">{BODY}</div><div role="contentinfo">© Lakeside</div>'), TEXT),
    (page(f'<article><h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p><section id="comments"><h2>Comments</h2><p>Tom says:</p><p>High time, the old one is rotten.</p><p>Reply</p></section></article>{_FOOT}'), TEXT),
]
