"""The labelled table of the page classifier, as pages written for it: each block is labelled by the ``data-y`` of the
nearest element around it, 1 for article text and 0 for what surrounds it. The label is never a feature.

The pages follow common layouts: news story, blog, forum thread, documentation, recipe, shop notice, bare page
without sections, table layout, page of adverts, and articles whose own parts have names that boilerplate has too.
"""

#: The attribute that holds a block's label.
LABEL = "data-y"

_LONG = "The council voted late on Monday to repair the old bridge, after two years in which engineers had warned that its northern arch would not stand another winter of heavy lorries."
_MID = "Work begins in March and should last until the first weeks of autumn, the mayor said."
_BRIEF = "Nobody was hurt."
_TALK = "I have crossed that bridge every day for thirty years and never saw anyone inspect it, so this comes as no surprise to me or my neighbours."
_LEGAL = "All rights reserved. No part of this site may be reproduced without the written permission of the publisher, who is not liable for the content of linked sites."
_COOKIE = "We use cookies to make this site better for you and to measure how it is read. By going on you agree to this use."
_OFFER = "Three months for the price of one: read everything, on every device, and cancel whenever you like."

PAGES = (
    # news story
    f"""<body><header data-y=0><div class=logo>The Daily Post</div><a href=/>Home</a></header><nav data-y=0><ul><li><a href=/a>World</a><li><a href=/b>Politics and the regions</a><li><a href=/c>Sport</a></ul></nav>
    <div class="cookie-notice" data-y=0>{_COOKIE}</div><div class="ad" data-y=0>{_OFFER}</div><main data-y=1><article><header><h1>Old bridge to be repaired</h1><p>By our reporter</p></header><p>{_LONG}</p><p>{_MID} <span class="ad" data-y=0>{_OFFER}</span> {_LONG}</p>
    <p>{_BRIEF}</p><h2 class="section-header">What comes next</h2><p>{_LONG} <a href=/x>Read the report of the engineers</a>.</p><div class="story-notice-body"><p>{_MID}</p></div><aside data-y=0><p>{_MID}</p><a href=/y>More about bridges</a></aside>
    <ul><li>Cost: two million</li><li>Length: ninety metres</li></ul><p><span class="note text">{_MID}</span> {_BRIEF}</p></article><section id="comments" data-y=0><h2>Comments</h2><div class="comment"><p>{_TALK}</p></div><div class="comment"><p>{_BRIEF}</p><p>{_TALK} {_TALK}</p></div></section></main>
    <aside class="sidebar" data-y=0><h3>Related</h3><ul><li><a href=/r>A tunnel under the river</a></li><li><a href=/s>Lorries to pay more</a></li></ul><p>{_LONG}</p></aside><footer data-y=0><p>{_LEGAL}</p><a href=/i>Imprint</a></footer></body>""",
    # blog, divs only
    f"""<body><div id="masthead" data-y=0>My garden diary</div><div id="navbar" data-y=0><a href=/>Start</a> <a href=/about>About me</a></div><div id="content" data-y=1><div class="post"><h2>Tomatoes</h2><div class="entry-content"><p>{_LONG}</p><p>{_BRIEF}</p><blockquote>{_MID}</blockquote><p>{_LONG}</p><p>{_MID}</p></div>
    <div class="share-buttons" data-y=0><a href=#>Share</a> <a href=#>Print</a></div><div class="post-tags" data-y=0><a href=#>garden</a> <a href=#>summer</a></div></div><div class="newsletter-signup" data-y=0><p>{_OFFER}</p></div><div id="respond" data-y=0><h3>Leave a reply</h3><form><label>Name</label><p>Your address will not be published.</p></form></div></div>
    <div id="sidebar-right" data-y=0><div class="widget"><h3>Archive</h3><ul><li><a href=#>May</a><li><a href=#>June</a></ul></div><div class="widget"><p>{_MID} {_TALK}</p></div></div><div id="footer" data-y=0><p>{_LEGAL}</p></div></body>""",
    # articles with parts of their own
    f"""<body><nav data-y=0><a href=/1>Docs</a><a href=/2>Guides and examples</a></nav><article data-y=1><h1>Installing the pump</h1><section class="warning"><h3>Warning</h3><p>{_LONG}</p><p>{_MID}</p></section><p>{_LONG}</p><div class="alert alert-info"><p>{_MID}</p></div><section class="notice"><p>{_LONG}</p></section><h2 class="header">Tools</h2><ul><li>A spanner</li><li>Oil</li></ul><pre>turn the valve
    twice</pre><p class="disclaimer">{_MID}</p><div class="search-tips"><p>{_LONG}</p></div><p>{_BRIEF}</p></article><footer data-y=0><div>Version 2</div></footer></body>""",
    # documentation with main and side menu
    f"""<body><div class="topbar" data-y=0>Search the manual</div><div class="menu" data-y=0><ul><li><a href=#>Intro</a><li><a href=#>Setup of the box</a><li><a href=#>Questions</a></ul></div><main data-y=1><h1>Setup</h1><p>{_MID}</p><table><tr><td>Width</td><td>40 cm</td></tr><tr><td>Weight</td><td>3 kg</td></tr></table><p>{_LONG}</p><dl><dt>Valve</dt><dd>{_MID}</dd></dl>
    <div class="pagination" data-y=0><a href=#>Back</a><a href=#>Next</a></div></main><div class="feedback" data-y=0><p>Was this page of any help?</p><a href=#>Yes</a> <a href=#>No</a></div><footer data-y=0>{_LEGAL}</footer></body>""",
    # bare page, no sections and no names
    f"""<body><div data-y=0><a href=/>Home</a></div><div data-y=0><a href=/n>News</a> <a href=/o>Older news</a></div><h1 data-y=1>A walk</h1><p data-y=1>{_LONG}</p><p data-y=1>{_MID}</p><p data-y=1>{_LONG} <a href=/m>A map</a></p><p data-y=1>{_BRIEF}</p><p data-y=1>{_TALK}</p><div data-y=0><a href=/p>Earlier</a> | <a href=/q>Later</a></div><p data-y=0><a href=/t>Contact</a></p></body>""",
    f"""<body><ul data-y=0><li><a href=/a>One</a><li><a href=/b>Two and three</a><li><a href=/c>Four</a></ul><div data-y=1><p>{_MID}</p><p>{_MID} {_MID}</p><h2>Why</h2><p>{_LONG}</p><ul><li>Because it rains</li><li>Because the river is high in the spring</li></ul><p>{_LONG}</p></div><ul data-y=0><li><a href=/d>Five things to see</a><li><a href=/e>Six</a></ul><div data-y=0><a href=/f>Print this page</a></div></body>""",
    # texts and nothing else; a text under a list of links
    f"""<body><p data-y=1>{_LONG}</p></body>""",
    f"""<body><h1 data-y=1>Rain</h1><p data-y=1>{_MID}</p><p data-y=1>{_LONG}</p></body>""",
    f"""<body><div data-y=0><a href=/>Top</a></div><p data-y=1>{_TALK}</p><p data-y=1>{_MID}</p></body>""",
    f"""<body><p data-y=1>{_MID}</p></body>""",
    f"""<body><p data-y=1>{_LONG}</p><ul data-y=0><li><a href=x>link</a><li><a href=y>another link</a></ul></body>""",
    f"""<article data-y=1><p>Short words.</p></article><div class="banner" data-y=0>{_OFFER}</div>""",
    # table layout
    f"""<body><table><tr><td data-y=0><a href=/>Index</a><br><a href=/g>Guest book</a></td><td data-y=1><h1>History of the mill</h1><p>{_LONG}</p><p>{_LONG}</p><p>{_BRIEF}</p></td><td data-y=0><a href=/l>Links</a><br><a href=/w>Web ring</a></td></tr></table><div data-y=0>Last change: May</div></body>""",
    # forum thread: the first post is the article, replies are readers' comments
    f"""<body><div class="breadcrumbs" data-y=0><a href=/>Forum</a> <a href=/b>Bridges</a></div><article data-y=1><h1>Is the bridge safe?</h1><div class="post-body"><p>{_TALK}</p><p>{_LONG}</p></div></article><div class="replies" data-y=0><article class="reply"><p>{_TALK}</p></article><article class="reply"><p>{_LONG}</p><p>{_BRIEF}</p></article></div><form class="login" data-y=0><p>Sign in to write a reply to this thread.</p></form></body>""",
    # recipe with adverts and promotion between the paragraphs
    f"""<body><header class="site-header" data-y=0><h1>Kitchen</h1><p>{_OFFER}</p></header><main data-y=1><h1>Bread</h1><p>{_LONG}</p><div class="advert" data-y=0><p>{_OFFER}</p></div><p>{_MID}</p><div class="promo-box" data-y=0><p>{_LONG}</p></div><h2>Steps</h2><ol><li>Mix the flour and the water.</li><li>Wait.</li><li>{_MID}</li></ol><div class="related-posts" data-y=0><h3>You may also like</h3><a href=#>Rolls</a></div>
    <p>{_LONG} <em class="sponsored" data-y=0>{_MID}</em></p><div class="cookie-consent" data-y=0>{_COOKIE}</div></main><div class="notice" data-y=0>{_COOKIE}</div><div class="disclaimer" data-y=0>{_LEGAL}</div><footer data-y=0><p>{_LEGAL}</p></footer></body>""",
    # articles in plain order between short leftovers without names
    f"""<body><nav data-y=0><ul><li><a href=#>A</a><li><a href=#>B</a></ul></nav><div data-y=0>{_OFFER}</div><article data-y=1><h1>Note</h1><p>{_LONG}</p><p>One.</p></article><div data-y=0>{_BRIEF}</div><footer data-y=0>&copy; the mill &middot; {_BRIEF}</footer></body>""",
    f"""<body><nav data-y=0><a href=#>Start here</a></nav><article data-y=1><h1>{_MID}</h1><p>{_LONG} {_LONG} {_LONG} {_LONG}</p><p><a href=#>{_BRIEF}</a></p><p>{_BRIEF}</p><p>{_LONG} {_LONG}</p></article><div class="social" data-y=0>{_OFFER}</div><footer data-y=0>{_LEGAL} {_LEGAL}</footer></body>""",
    # short articles, some before links
    f"""<article data-y=1><p>Closed.</p></article>""",
    f"""<body><main data-y=1><p>Closed today.</p></main><nav data-y=0><a href=/1>Start</a></nav></body>""",
    f"""<body><nav data-y=0><a href=/1>Start</a></nav><article data-y=1><h2>Hours</h2><p>Nine to five.</p><p>Never on Sunday</p></article><p data-y=0><a href=/2>Back to the start</a></p></body>""",
    f"""<body><article data-y=1><p>The door</p></article><div data-y=0><a href=/1>Back</a></div></body>""",
    f"""<body><article data-y=1><p>Found: a key on a red string.</p><ul><li>Ask at the desk</li></ul></article><footer data-y=0><a href=/1>Imprint</a></footer></body>""",
    f"""<body><div class="entry-content" data-y=1><h1>Two words</h1></div><div data-y=0><a href=/2>Earlier words</a></div></body>""",
    # tags but no main element; names but no main name
    f"""<body><header data-y=0><p>The valley paper</p><p>{_OFFER}</p></header><nav data-y=0><p>Pages of this paper</p><a href=/a>First</a></nav><div data-y=1><h1>Snow on the pass</h1><p>{_LONG}</p><p>{_BRIEF}</p><p>{_MID} {_LONG}</p><ul><li>Chains are needed</li><li>Buses run</li></ul></div><aside data-y=0><p>{_LONG}</p><p>{_TALK}</p></aside><form data-y=0><p>{_MID}</p></form><footer data-y=0><p>{_LEGAL}</p><p>{_BRIEF}</p></footer></body>""",
    f"""<body><div class="menubar" data-y=0>Shop and workshop</div><div class="cookie-bar" data-y=0><p>{_COOKIE}</p></div><div class="page" data-y=1><h1>Repairs</h1><p>{_MID}</p><p>{_LONG}</p><p>Ask first.</p><p>{_TALK}</p></div><div class="sponsored-links" data-y=0><p>{_OFFER}</p><p>{_LONG}</p></div><div class="user-comments" data-y=0><p>{_TALK}</p><p>{_TALK} {_LONG}</p><p>{_BRIEF}</p></div><div class="page-footer" data-y=0><p>{_LEGAL}</p></div></body>""",
    f"""<body><aside data-y=0><p>{_MID}</p></aside><section data-y=1><h2>Ferries</h2><p>{_LONG}</p><p>{_MID}</p><div class="warning"><p>{_LONG}</p></div><p>{_BRIEF}</p></section><form data-y=0><label>Your name</label><p>{_OFFER}</p></form><div data-y=0>Contact</div></body>""",
    # leftovers without names beside an unnamed article
    f"""<body><div data-y=0>Welcome</div><div data-y=0><a href=/1>Inside</a></div><div data-y=0>Menu</div><div data-y=0><a href=/2>Outside the walls</a></div><div data-y=1><p>{_TALK}</p><p>{_LONG}</p><p>{_MID}</p></div><div data-y=0><a href=/3>Up</a></div><div data-y=0>2019</div><div data-y=0><a href=/4>Down</a></div></body>""",
    f"""<body><div data-y=0><a href=/1>List</a></div><div data-y=0>Sorted by date</div><div data-y=0><a href=/2>Table of the whole year</a></div><p data-y=1>{_LONG}</p><p data-y=1>{_LONG} <a href=/4>{_BRIEF}</a></p><div data-y=0><a href=/6>{_MID}</a></div><div data-y=0>Page 3</div><div data-y=0><a href=/7>{_OFFER}</a></div></body>""",
)
