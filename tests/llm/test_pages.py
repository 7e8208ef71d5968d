"""Main text of hand-written pages whose structure the training pages don't have: blocks kept and lost."""

from cohortstats.llm import html_extract

P = "The council met on Tuesday to discuss the new bridge, which engineers say will take three years to finish."
Q = "Residents of the eastern district asked for a second crossing, since traffic doubles in the summer months."
R = "A spokesperson said that the budget will be published next week, and that comments are welcome until May."
S = "The first stones were laid in 1911, when horses still carried timber from the forests to the harbour."

#: page, blocks of its article, and what isn't of it
PAGES = [
    (f"<html><body><table width=100%><tr><td class=left><a href=/>Home</a><br><a href=/n>News</a><br><a href=/s>Sport</a></td><td><h2>Bridge vote</h2><p>{P}</p><p>{Q}</p><p>{R}</p></td></tr><tr><td colspan=2>Copyright 2004 The Paper. All rights reserved.</td></tr></table></body></html>",
     ["Bridge vote", P, Q, R], ["Home", "Sport", "Copyright 2004 The Paper"]),
    (f"<!doctype html><html><head><title>t</title><style>.x{{color:red}}</style></head><body><div id=wrap><div class=top-bar><ul><li><a href=a>About</a></li><li><a href=b>Contact</a></li></ul></div><div class='post-body entry-content'><h1>On stones</h1><div>{S}</div><div>{P}</div><blockquote>{Q}</blockquote></div><div class=sharedaddy>Share this: <a href=f>Facebook</a> <a href=t>Twitter</a></div><div id=comments><h3>2 responses</h3><p>Great post, thanks!</p><p>I disagree with all of it.</p></div></div></body></html>",
     ["On stones", S, P, Q], ["About", "Facebook", "Great post", "I disagree"]),
    (f"<html><body><header role=banner><nav><a href=1>World</a> <a href=2>Business</a></nav></header><main><article><h1>Crossing delayed</h1><figure><img src=a.jpg><figcaption>Workers at the site in spring.</figcaption></figure><p>{Q}<p>{R}<p>{S}</article><aside><h4>Most read</h4><ol><li><a href=x>Ten ways to cook rice</a></li><li><a href=y>Storm nears coast</a></li></ol></aside></main><footer>Terms | Privacy | Cookies</footer></body></html>",
     ["Crossing delayed", Q, R, S], ["Business", "Most read", "Ten ways to cook", "Privacy"]),
    (f"<html><body><div class=cookie-consent>We use cookies to improve your visit. <button>Accept</button></div><section class=hero><h1>Guide to the river</h1></section><section><h2>History</h2><p>{S}</p><ul><li>{P}</li><li>{R}</li></ul><h2>Today</h2><p>{Q}</p></section><form><label>Email</label><input name=e><button>Subscribe</button></form><script>var a='not text';</script></body></html>",
     ["Guide to the river", "History", S, P, R, "Today", Q], ["We use cookies", "Subscribe", "not text"]),
    (f"<html><body><center><font size=5><b>My page</b></font></center><hr>{P}<br><br>{Q}<br><br>{S}<hr><a href=p.html>prev</a> | <a href=n.html>next</a></body></html>",
     [P, Q, S], ["prev", "next"]),
    (f"<html><body><div class=layout><div class=layout__side><div class=widget><h5>Tags</h5><a href=1>bridge</a> <a href=2>river</a> <a href=3>city</a></div><div class='widget promo'><p>Sign up now and save 20% on your first order!</p></div></div><div class=layout__content><div class=breadcrumb><a href=/>Start</a> &gt; <a href=/c>City</a></div><h1>Budget</h1><p class=byline>By A. Writer, 4 May</p><p>{R}</p><p>{P}</p><pre>total = 1200</pre><p>{S}</p></div></div></body></html>",
     ["Budget", R, P, S], ["Tags", "Sign up now", "Start"]),
]


def test_blocks_of_other_pages(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", html) for i, (html, _, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    missed = [(i, b) for i, (_, blocks, _) in enumerate(PAGES) for b in blocks if b not in got[i]]
    extra = [(i, b) for i, (_, _, other) in enumerate(PAGES) for b in other if b in got[i]]
    kept, wrong = sum(len(b) for _, b, _ in PAGES), sum(len(o) for _, _, o in PAGES)
    print(f"blocks kept {kept - len(missed)} of {kept}, other texts kept {len(extra)} of {wrong}", missed, extra)
    assert len(missed) <= 0.1 * kept and len(extra) <= 0.25 * wrong
