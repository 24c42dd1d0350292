"""Pages written by hand, as different site builders lay them out, and the text that belongs to the article."""

BLOG = ("""<!doctype html><html lang=en><head><title>Sourdough | Crumb Notes</title><link rel=stylesheet href=a.css><script>window.x={a:"</div>"}</script></head>
<body class="post-template-default single single-post"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<div id="page" class="site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">Crumb Notes</a></p><p class="site-description">Bread, mostly</p></div>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li><a href="/about">About</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/contact">Contact</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-41" class="post-41 post type-post"><h1 class="entry-title">Why my sourdough failed</h1>
<div class="entry-content"><p>For three weeks the dough would not rise. I blamed the flour, then the kitchen, and finally the starter&#8217;s age.</p>
<p>It was the water. Our town adds chloramine, which does <em>not</em> gas off overnight the way chlorine does.</p>
<h2>What I changed</h2><ol><li>Filtered water through active carbon.</li><li>Fed the starter twice a day for a week.</li></ol>
<p>The next loaf doubled in five hours. I have not looked back since then.</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><b class="fn">Mara</b><div class="comment-content"><p>Same here! Thanks for writing it up.</p></div></li><li class="comment"><b class="fn">Joe</b><div class="comment-content"><p>Boiling works too, at least for us.</p></div></li></ol>
<form id="commentform" class="comment-form"><label>Name</label><input><textarea>Say something</textarea><button>Post</button></form></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2>Recent posts</h2><ul><li><a href=1>Rye at last</a></li><li><a href=2>On salt</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly baked with care. &copy; 2023</div></footer></div></body></html>""",
"""Why my sourdough failed
For three weeks the dough would not rise. I blamed the flour, then the kitchen, and finally the starter\u2019s age.
It was the water. Our town adds chloramine, which does not gas off overnight the way chlorine does.
What I changed
Filtered water through active carbon.
Fed the starter twice a day for a week.
The next loaf doubled in five hours. I have not looked back since then.""")

DOCS = ("""<html><head><meta charset=utf-8><title>Retry policies</title></head><body><div class="navbar"><a href="/">Docs</a> <a href="/api">API</a> <a href="/blog">Blog</a></div>
<div class="layout"><div class="sidebar"><ul class="toc"><li><a href="#a">Overview</a><li><a href="#b">Backoff</a><li><a href="#c">Limits</a></ul></div>
<div class="content markdown-body"><h1>Retry policies</h1><p>A client repeats a call that failed for a reason that may pass. Calls that changed something are repeated only if they carry a key.</p>
<h2 id=b>Backoff</h2><p>The wait doubles after each attempt, up to <code>max_wait</code>.</p><pre><code>retry(max_wait=30)</code></pre>
<table><tr><th>Code</th><th>Repeated</th></tr><tr><td>429</td><td>always</td></tr><tr><td>400</td><td>never</td></tr></table>
<p>If all attempts fail, the last error is raised with the number of attempts in its message.</p></div></div>
<div class="cookie-banner" role="alert"><p>This site uses cookies to measure visits.</p><button>Accept</button><button>Refuse</button></div>
<div class="footer">Built from commit 81ab. Edit this page.</div></body></html>""",
"""Retry policies
A client repeats a call that failed for a reason that may pass. Calls that changed something are repeated only if they carry a key.
Backoff
The wait doubles after each attempt, up to max_wait.
retry(max_wait=30)
Code
Repeated
429
always
400
never
If all attempts fail, the last error is raised with the number of attempts in its message.""")

NEWS = ("""<!DOCTYPE html><html><head><title>Bridge reopens</title><style>.ad{display:block}</style></head><body>
<div id="top-bar"><a href=/subscribe>Subscribe</a> | <a href=/login>Log in</a></div><div class="ad-slot">Advertisement</div>
<div class="breadcrumbs"><a href=/>Home</a> &raquo; <a href=/local>Local</a></div>
<div id="story" class="story-body"><h1>Old bridge reopens after two years</h1>
<p>The iron bridge over the Lenn was opened to traffic again on Monday morning, two years after inspectors found cracks in its northern pier.
<p>"We took longer than we said we would," the town's engineer admitted, "but the pier is now better than it was in 1911."
<div class="advert"><p>Save 40% on winter tyres!</p></div>
<p>Repairs cost 3.2 million, a third more than planned. Lorries above 12 tonnes must still take the ring road.
<p>A festival is to mark the day in June.
</div>
<div class="related-stories"><h3>More from Local</h3><ul><li><a href=a>Library hours cut</a></li><li><a href=b>Flood wall finished</a></li><li><a href=c>Market moves to square</a></li></ul></div>
<div class="newsletter-signup"><p>Get the morning letter in your inbox.</p><form><input type=email><button>Sign up</button></form></div>
<div id="footer"><p>The Lenn Courier. All rights reserved.</p><a href=/imprint>Imprint</a> <a href=/privacy>Privacy</a></div></body></html>""",
"""Old bridge reopens after two years
The iron bridge over the Lenn was opened to traffic again on Monday morning, two years after inspectors found cracks in its northern pier.
"We took longer than we said we would," the town's engineer admitted, "but the pier is now better than it was in 1911."
Repairs cost 3.2 million, a third more than planned. Lorries above 12 tonnes must still take the ring road.
A festival is to mark the day in June.""")

BARE = ("""<html><body bgcolor=white><h1>Notes on grafting</h1><p>Cut the scion in winter while it sleeps, and keep it in damp sand.<p>In April the bark slips. Make a T in the stock, lift the edges, and push the bud in.<ul><li>Bind it, but not over the bud.<li>Loosen the tape after six weeks.</ul><p>Written by hand in 1998.</body></html>""",
"""Notes on grafting
Cut the scion in winter while it sleeps, and keep it in damp sand.
In April the bark slips. Make a T in the stock, lift the edges, and push the bud in.
Bind it, but not over the bud.
Loosen the tape after six weeks.
Written by hand in 1998.""")

SHOP = ("""<html><body><header class="header"><form role="search"><input placeholder="Search"><button>Go</button></form><nav class="mega-menu"><ul><li><a href=1>Tents</a><ul><li><a href=2>Two person</a><li><a href=3>Family</a></ul><li><a href=4>Stoves</a></ul></nav></header>
<main><section class="guide"><h1>How to choose a stove</h1><p>Gas is easy and clean. Petrol burns in the cold, when gas no longer flows, and is sold everywhere.</p><p>For one person a small burner of 90 grams is enough; groups want a wide base and a pot that cannot tip.</p><blockquote><p>Buy the stove for the coldest night, not the nicest day.</p></blockquote></section>
<section class="recommended-products"><h2>You may also like</h2><div class="card"><a href=5>Alpha burner</a><span>39.90</span></div><div class="card"><a href=6>Beta burner</a><span>59.90</span></div></section></main>
<footer class="footer"><ul><li><a href=7>Returns</a><li><a href=8>Shipping</a></ul><p>Prices include tax.</p></footer></body></html>""",
"""How to choose a stove
Gas is easy and clean. Petrol burns in the cold, when gas no longer flows, and is sold everywhere.
For one person a small burner of 90 grams is enough; groups want a wide base and a pot that cannot tip.
Buy the stove for the coldest night, not the nicest day.""")

SCIENCE = ("""<html><head><title>Mass and energy</title></head><body><div id="nav"><a href=a>Home</a><a href=b>Topics</a></div><article><h1>Mass and energy</h1>
<p class=it's>A body at rest has the energy <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math>, which does not depend on what it's made of.</p>
<p>A gram of anything holds as much as a small town uses in a week, though nobody can take all of it out.</p><noscript><p>The figure needs scripts: it shows the two scales side by side.</p></noscript>
<figure><img src=f.png alt=""><figcaption>Two scales, one for each side.</figcaption></figure></article><div class="share-buttons"><a href=x>Share</a><a href=y>Tweet</a></div><footer>Licensed for reuse.</footer></body></html>""",
"""Mass and energy
A body at rest has the energy E=mc2, which does not depend on what it's made of.
A gram of anything holds as much as a small town uses in a week, though nobody can take all of it out.
The figure needs scripts: it shows the two scales side by side.
Two scales, one for each side.""")

PAGES = {"blog": BLOG, "docs": DOCS, "news": NEWS, "bare": BARE, "shop": SHOP, "science": SCIENCE}
