"""Small pages of varied layout, labelled by hand, and the main text of each; none of them is trained on."""

COOKIE = "<div class='cookie-bar'><p>We use cookies to make this site work.</p><button>Fine</button></div>"
LEGAL = "<div class='legal'>All rights reserved by Acme Ltd</div>"
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/a>About us</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2020 Acme</p><ul><li><a href=/p>Privacy</a></li><li><a href=/t>Terms</a></li></ul></footer>"
LATEST = "<aside><h3>Latest</h3><ul><li><a href=/1>Port opens again</a></li><li><a href=/2>Rain in the north</a></li><li><a href=/3>New school term</a></li></ul></aside>"

PAGES = {
    "short_main": (f"<body>{COOKIE}<main><h1>Opening hours</h1><p>Only one short line.</p></main>{LEGAL}</body>", "Opening hours\nOnly one short line."),
    "link_items": (f"<body>{MENU}<main><h1>Release notes</h1><p>These versions can be had.</p><ul><li><a href=/r3>Version three with the new reader</a></li><li><a href=/r2>Version two mends the writer</a></li><li><a href=/r1>Version one</a></li></ul></main>{LATEST}{FOOT}</body>",
        "Release notes\nThese versions can be had.\nVersion three with the new reader\nVersion two mends the writer\nVersion one"),
    "details": (f"<body>{MENU}<article><h1>How to plant</h1><p>Plant the seeds in spring, when the ground is warm.</p><details><summary>More</summary><p>In cold places wait for the last frost to pass, and cover the bed at night.</p></details></article>{FOOT}</body>",
        "How to plant\nPlant the seeds in spring, when the ground is warm.\nMore\nIn cold places wait for the last frost to pass, and cover the bed at night."),
    "page_form": (f"<body><form id=aspnetForm method=post action=page.aspx><input type=hidden name=s value=x>{MENU}<article><h1>Council meets</h1><p>The council met on Monday to talk about the bridge.</p><p>It will meet again in May.</p></article>{FOOT}</form></body>",
        "Council meets\nThe council met on Monday to talk about the bridge.\nIt will meet again in May."),
    "unnamed_comments": (f"<body>{MENU}<article><h1>The old mill</h1><p>The mill by the river was built in the year of the flood, and stands yet.</p><p>Visitors can see its wheel turn on Sundays.</p></article><div class='zz-9'><h4>Ann</h4><p>I went there as a child. Lovely!</p></div><div class='zz-9'><h4>Bob</h4><p>Is it open in winter?</p></div><div class='zz-9'><h4>Cy</h4><p>Yes it is.</p></div>{FOOT}</body>",
        "The old mill\nThe mill by the river was built in the year of the flood, and stands yet.\nVisitors can see its wheel turn on Sundays."),
    "unnamed_side": (f"<body>{MENU}<main><h1>Harvest</h1><p>The harvest was good this year, said the farmers of the valley.</p></main><div class='k-3'><h3>Latest</h3><ul><li><a href=/1>Port opens again</a></li><li><a href=/2>Rain in the north</a></li></ul></div>{FOOT}</body>",
        "Harvest\nThe harvest was good this year, said the farmers of the valley."),
    "one_paragraph": (f"<body>{MENU}<main><p>The page that you want has moved.</p></main>{FOOT}</body>", "The page that you want has moved."),
    "sections": (f"<body><header><a href=/>Acme</a><p>Tools for all</p></header><main><section><h2>Install</h2><p>Run the installer and wait.</p></section><section><h2>Use</h2><p>Open a file with the reader.</p><pre>reader file.txt</pre></section></main>{FOOT}</body>",
        "Install\nRun the installer and wait.\nUse\nOpen a file with the reader.\nreader file.txt"),
    "header_in_article": (f"<body>{MENU}<article><h1>A walk</h1><p>We walked from the station to the sea, a way of two hours.</p><h2>The way back</h2><p>Take the bus.</p><ol><li>Buy a ticket</li><li>Wait at the stop</li></ol></article>{LATEST}{FOOT}</body>",
        "A walk\nWe walked from the station to the sea, a way of two hours.\nThe way back\nTake the bus.\nBuy a ticket\nWait at the stop"),
    "sources": (f"<body>{MENU}<article><h1>Tides</h1><p>The moon draws the sea, as many have written.</p><h2>Sources</h2><ul><li><a href=/s1>A history of the sea, second edition</a></li><li><a href=/s2>The moon and the tides</a></li></ul></article>{FOOT}</body>",
        "Tides\nThe moon draws the sea, as many have written.\nSources\nA history of the sea, second edition\nThe moon and the tides"),
    "advert_within": (f"<body>{MENU}<article><h1>Bread</h1><p>Mix flour and water and leave it for a night.</p><div class='ad-box'><a href=/buy>Buy our mixer today</a></div><p>Bake it for an hour in a hot oven.</p></article>{FOOT}</body>",
        "Bread\nMix flour and water and leave it for a night.\nBake it for an hour in a hot oven."),
    "faq": (f"<body>{COOKIE}{MENU}<main><h1>Questions</h1><details><summary>Can I pay by card?</summary><p>Yes, in all our shops.</p></details><details><summary>Do you send abroad?</summary><p>We send to all countries of the union.</p></details></main>{FOOT}</body>",
        "Questions\nCan I pay by card?\nYes, in all our shops.\nDo you send abroad?\nWe send to all countries of the union."),
}


def scores(extract, pages: dict[str, tuple[str, str]] = PAGES) -> tuple[float, float, dict[str, tuple[list[str], list[str]]]]:
    """Precision and recall by block over all pages, and per page the blocks that are missing and those too many."""
    right = found = wanted = 0
    wrong = {}
    for name, (page, text) in pages.items():
        got, want = extract(page).split("\n") if extract(page) else [], text.split("\n")
        right += sum(b in want for b in got)
        found, wanted = found + len(got), wanted + len(want)
        if got != want:
            wrong[name] = ([b for b in want if b not in got], [b for b in got if b not in want])
    return right / max(found, 1), right / wanted, wrong

#: Written after the generator was last changed, to see how it does on layouts that it was not made for.
UNSEEN = {
    "recipe": (f"<body><div class='site-top'><a href=/>Kitchen</a></div>{MENU}<main><h1>Lentil soup</h1><ul><li>Two cups of lentils</li><li>One onion</li></ul><ol><li>Cut the onion and fry it.</li><li>Add the lentils and boil them.</li></ol></main>{LATEST}{FOOT}</body>",
        "Lentil soup\nTwo cups of lentils\nOne onion\nCut the onion and fry it.\nAdd the lentils and boil them."),
    "press": (f"<body>{MENU}<div class='main-content'><h1>New plant opens</h1><p>The company opened its third plant on Friday.</p><blockquote><p>We are glad to be here.</p></blockquote><p>The plant will make pumps.</p></div><div class='sidebar'><h3>Contact</h3><p>Call the press office.</p></div>{FOOT}</body>",
        "New plant opens\nThe company opened its third plant on Friday.\nWe are glad to be here.\nThe plant will make pumps."),
    "table": (f"<body>{MENU}<article><h1>Results</h1><p>These are the results of the day.</p><table><tr><th>Team</th><th>Points</th></tr><tr><td>North</td><td>12</td></tr><tr><td>South</td><td>9</td></tr></table></article>{FOOT}</body>",
        "Results\nThese are the results of the day.\nTeam\nPoints\nNorth\n12\nSouth\n9"),
    "modal": (f"<body><div id='modal-box'><h2>Join our list</h2><p>Get news every week.</p><form><input name=e><button>Join</button></form></div>{MENU}<article><h1>Rivers</h1><p>Rivers carry sand to the sea.</p></article>{FOOT}</body>", "Rivers\nRivers carry sand to the sea."),
    "named_comments": (f"<body>{MENU}<article><h1>Owls</h1><p>Owls hunt at night, and hear a mouse below the snow.</p><section id='comments'><h3>Two comments</h3><article><b>Dee</b><p>Great picture!</p></article><article><b>Ed</b><p>I saw one too.</p></article></section></article>{FOOT}</body>",
        "Owls\nOwls hunt at night, and hear a mouse below the snow."),
    "letters": (f"<body>{COOKIE}<main><div class='q-7'><h1>Letter</h1><p>Dear friends, the winter was long.</p><p>We hope to see you in spring.</p><p>Yours, the club</p></div></main>{LEGAL}</body>", "Letter\nDear friends, the winter was long.\nWe hope to see you in spring.\nYours, the club"),
    "glossary": (f"<body>{MENU}<main><h1>Words of the sea</h1><dl><dt>Bow</dt><dd>The front of a boat.</dd><dt>Stern</dt><dd>Its back.</dd></dl><p>See also <a href=/k>knots</a>.</p></main>{FOOT}</body>", "Words of the sea\nBow\nThe front of a boat.\nStern\nIts back.\nSee also knots."),
    "form_page_plain": (f"<body><form action=/f><input type=hidden name=v value=1><div class='nav-bar'><a href=/a>One</a> <a href=/b>Two</a></div><div class='content'><h1>Notice of works</h1><p>The road will be closed on Tuesday.</p></div><div class='footer'>Town hall</div></form></body>", "Notice of works\nThe road will be closed on Tuesday."),
}
