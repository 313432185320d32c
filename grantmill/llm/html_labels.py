"""The small labelled table for the block classifier: page layouts with the article's blocks marked by data-y="1".

Each layout stands with several bodies, so that paragraphs of one word and of many stand first, in the middle and
last in every one of them. In the layouts without article or main element, word counts and link densities decide."""

_LONG = "The committee met on Tuesday to hear the report on the harbour works and, after two hours, agreed to go on with the plan as drawn."
_MID = "Nobody spoke against it when the vote was called."
_ONE = "Agreed."
_Y = ' data-y="1"'

#: Paragraphs of the article, in order.
BODIES = (
    (_LONG, _MID, _LONG),
    (_LONG + " " + _LONG, _ONE, _LONG, _MID),
    (_MID, _LONG, _LONG + " " + _MID, "So it went until the evening came."),
    (_MID, _MID, _LONG),
    (_LONG, _LONG, _MID, "The works begin in May and end a year later."),
)
_NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>"
_TOP = "<div class=menu><a href=1>One</a> <a href=2>Two</a></div>"
_LINKS = "<div><a href=1>Home</a></div><div><a href=2>Maps of the coast</a></div>"
_TABLE = "<table><tr><td><a href=1>Start</a></td><td><a href=2>Archive</a></td><td><a href=3>Links</a></td></tr></table>"
_AD = "<div class=ad>Buy two pans today and get a lid.</div>"
_FOOT = "<footer>&copy; Harbour Post, all rights reserved</footer>"
_COOKIES = f"<div id=cookie-notice><p>We use cookies to make this site work. Read the policy before you go on.</p><button>Accept all</button></div><div class=banner><p>{_LONG}</p></div>"
_COMMENTS = f"<section class=comments><h3>Comments</h3><p>{_LONG}</p><p>Nice piece, thank you.</p><p>{_MID}</p></section>"
_SIDE = f"<aside><h4>Popular</h4><p>{_MID}</p><p>{_LONG}</p><ul><li><a href=1>Read the other story</a></li></ul></aside>"
_FORM = "<form action=/q><p>Leave your address and we write to you.</p><label>Mail</label><input name=q><button>Go</button></form>"
_SHARE = "<p class=share><a href=f>Share</a> <a href=t>Post</a></p>"
_RELATED = f"<div class=related><a href=4>{_MID}</a></div>"


def _paragraphs(body: tuple[str, ...], tag: str = "p") -> str:
    return "".join(f"<{tag}{_Y}>{x}</{tag}>" for x in body)


def pages() -> list[str]:
    out = []
    for k, body in enumerate(BODIES):
        p, div, head = _paragraphs(body), _paragraphs(body, "div"), f"<h1{_Y}>Harbour plan</h1>"
        cut = len(body) // 2
        first, last = _paragraphs(body[:cut]), _paragraphs(body[cut:])
        short = f"<p{_Y}>{_ONE}</p><p{_Y}>Two of them.</p>"
        out += [f"<body>{x}</body>" for x in (
            f"{_NAV}{_AD}<article>{head}{p}</article>{_FOOT}",
            f"{_NAV}{_AD}<article>{head}{first}{short}{last}{short}</article>{_FOOT}",
            f"<header><a href=/>The Post</a><p>Weather: fine, 12 degrees</p></header><main>{head}{first}{_SIDE}{last}{short}{_COMMENTS}</main>{_FOOT}",
            f"{_FORM}<article class=post><header>{head}</header><blockquote{_Y}>{_MID}</blockquote>{p}<ul><li{_Y}>a first point about the works</li><li{_Y}>a second</li></ul>{_SHARE}{_FORM}{_COMMENTS}</article>{_RELATED}",
            f"{_COOKIES}{_TOP}<div class=content>{head}{p}</div>{_SIDE}<div>Imprint <a href=3>Contact</a></div>",
            f"{_TOP}<main>{first}<pre{_Y}>x = 1 and then y</pre><nav><a href=1>1</a> <a href=2>2</a></nav><p{_Y}>as <a href=5>the report</a> says, {_MID}</p>{last}</main><div class=footer><p>{_MID}</p></div>",
            # no article element and no telling names
            f"{_LINKS}{div}<div>Copyright and contact</div><div><a href=3>Top</a></div>",
            f"{_TABLE}{p}<p><a href=6>Back</a> <a href=7>Next</a></p><p>Last change: May</p>",
            f"{p}",
            f"{head}{p}",
            f"{div}",
            f"{_LINKS}{head}{p}",
            f"<div id=page><div id=c1>{head}{p}</div></div>",
            f"<table><tr><td><a href=1>Start</a></td></tr><tr><td>{p}</td></tr></table>",
            f"{_LINKS}{first}<p{_Y}>{_LONG} See <a href=5>the report</a>.</p>{last}<div><a href=8>Terms</a> <a href=9>Imprint</a></div>",
        )]
        if k == 0:
            out.append(f"<body>{_NAV}<article><p{_Y}>{_MID}</p></article><footer><p>&copy; site</p></footer></body>")
    return out
