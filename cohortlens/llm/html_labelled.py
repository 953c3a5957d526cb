"""Labelled pages that the extractor is trained on: own markup of common page layouts.

``y="1"`` marks an element whose subtree is main text, ``y="0"`` one inside it
that is not; the attribute is no feature. Elements without it are labelled
like their parent, the root 0.
"""

_LONG = "Here is a paragraph of running prose that goes on for a while, long enough to look like an article and unlike a label."
_LONGER = f"{_LONG} {_LONG}"
_MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "sport", "about us"))
_COMMENT = '<div class="comment"><span class="author">ann</span><p>I do not agree with this at all, and I said so before.</p><a href="#">Reply</a></div>'
_COOKIE = '<div class="cookie-notice">We use cookies to give you the best experience on this site. <button>Accept</button></div>'

PAGES = [
    # article element, menu before, advert, footer behind
    f'<html><body><nav><ul>{_MENU}</ul></nav><div class="ad">Buy one, get one free today only.</div><article y="1"><h1>A title of some words</h1><p>{_LONG}</p><p>Short one.</p><p>{_LONGER}</p></article><footer>&copy; example.com &middot; All about us and our terms.</footer></body></html>',
    f'<html><body><nav><ul>{_MENU}</ul></nav><article y="1"><h1>Title</h1><p>{_LONG}</p></article><footer>Contact us.</footer></body></html>',
    f'<html><body><header><h1>The Site</h1><nav>{_MENU}</nav></header><main y="1"><h1>Title of the page</h1><p>{_LONG}</p><p>{_LONG}</p><ul><li>first point of the list</li><li>second point</li></ul><p>{_LONG}</p></main><aside class="sidebar"><h3>Related</h3><ul>{_MENU}</ul><p>Sign up and never miss a story from our desk again.</p></aside><footer><p>Copyright of the publisher, all rights reserved.</p></footer></body></html>',
    # div layouts with speaking classes
    f'<html><body><div id="header"><div class="logo">Site</div><div class="menu"><ul>{_MENU}</ul></div></div><div id="content" y="1"><h2>Heading here</h2><p>{_LONG}</p><div class="share-buttons" y="0"><a href="#">Tweet</a> <a href="#">Share</a></div><p>{_LONGER}</p></div><div id="sidebar"><div class="widget"><h3>Popular</h3><ul>{_MENU}</ul></div></div><div id="footer">Terms of use and privacy of the site.</div></body></html>',
    f'<html><body>{_COOKIE}<div class="wrapper"><div class="post" y="1"><h1 class="title">Post title</h1><div class="entry-content"><p>{_LONG}</p><blockquote><p>{_LONG}</p></blockquote><p>{_LONG}</p><pre>some code here</pre></div></div><div id="comments"><h3>3 comments</h3>{_COMMENT}{_COMMENT}{_COMMENT}</div></div><footer><ul>{_MENU}</ul></footer></body></html>',
    f'<html><body><header>Site name and a slogan for the reader</header><article y="1"><header><h1>Title in a header</h1><p>By the author</p></header><p>{_LONG}</p><aside class="promo" y="0"><p>Subscribe now and get the first month free of charge.</p></aside><p>{_LONGER}</p><section class="comments" y="0"><h2>Comments</h2>{_COMMENT}{_COMMENT}</section></article></body></html>',
    # comments as a list inside the article
    f'<html><body><nav>{_MENU}</nav><article y="1"><h1>Title</h1><p>{_LONG}</p><p>{_LONG}</p><div class="comments" y="0"><ol><li><p>{_LONG}</p></li><li><p>First!</p></li></ol><form><p>Leave a reply</p><label>Name</label><button>Send</button></form></div></article></body></html>',
    # plain pages
    f'<html><body y="1"><h1>Plain page</h1><p>{_LONG}</p><p>{_LONGER}</p><p>{_LONG}</p></body></html>',
    f'<html><body><ul>{_MENU}</ul><h1 y="1">Heading of it</h1><p y="1">{_LONG}</p><p y="1">{_LONGER}</p><p y="1">{_LONG}</p><form><p>Search the site</p><input name="q"></form></body></html>',
    f'<html><body><div>{_MENU}</div><div y="1"><p>{_LONG}</p><p>{_LONG}</p><p>{_LONGER}</p></div><div class="popup"><p>Wait, do not leave yet, join our newsletter.</p></div></body></html>',
    # sections, table, lists as main text
    f'<html><body><header class="masthead"><a href="/">Home</a></header><div role="main" y="1"><section><h2>One</h2><p>{_LONG}</p></section><section><h2>Two</h2><p>{_LONG}</p><table><tr><td>a cell</td><td>another cell</td></tr></table><ol><li>{_LONG}</li><li>short step</li></ol></section></div><div role="navigation">{_MENU}</div><div class="banner">The sale ends soon, so hurry up and buy.</div></body></html>',
    f'<html><body><form class="login"><p>Log in</p><label>User</label><input></form><main y="1"><article><h1>Title</h1><figure><figcaption>A caption of the picture</figcaption></figure><p>{_LONG}</p><p>{_LONG} <a href="#">a link</a> in it.</p></article></main><section class="related"><h2>More stories</h2><ul>{_MENU}</ul></section><footer><nav>{_MENU}</nav><p>The publisher, a street, a town.</p></footer></body></html>',
    f'<html><body><div class="alert">Important: our offices are closed on Monday.</div><div class="article-body" y="1"><p>{_LONG}</p><p>{_LONGER}</p><div class="advert" y="0">Advertisement: the best shoes in town.</div><p>{_LONG}</p></div><div class="breadcrumbs"><a href="/">Home</a> <a href="/n">News</a></div></body></html>',
    # unclosed paragraphs and line breaks
    f'<html><body><nav><ul>{_MENU}</ul></nav><div class="ad">A very good offer.</div><article y="1"><h1>Title</h1><p><b>Bold first line.<br><p>{_LONG}<p>Tiny.<p>{_LONGER}</article><footer>&copy; the site</footer>',
    f'<html><body><article y="1"><h1>Only a title</h1><p>One.</p></article><footer>The end of it, really.</footer></body></html>',
    f'<html><body><nav><ul>{_MENU}</ul></nav><article y="1"><p>One short line.</p><p>Two.</p></article><aside><p>{_LONG}</p></aside><footer><p>{_LONG}</p></footer></body></html>',
]

for _main in ('div role="main"', 'div class="content"', 'div id="main"', "main", 'div class="post-body"'):
    _end = _main.split()[0]
    PAGES += [
        f'<html><body><nav>{_MENU}</nav><{_main} y="1"><section><h2>One</h2><p>{_LONG}</p></section><section><h2>Two</h2><ul><li>short step</li></ul><table><tr><td>a cell</td></tr></table></section></{_end}><footer>End.</footer></body></html>',
        f'<html><body><header>Site</header><div class="wrapper"><{_main} y="1"><h1>One</h1><p>Short.</p><p>{_LONG}</p></{_end}><div class="comments"><p>{_LONG}</p></div></div><footer>End.</footer></body></html>',
    ]

# The same kinds of boxes with little, more and much text in them: length alone tells no main text.
for _fill in ("A few words here.", _LONG, _LONGER):
    for _box in ("aside", "form", 'div class="ad"', 'div class="notice"', 'section class="comments"', 'div id="sidebar"', 'div class="related"', 'div class="menu"'):
        _end = _box.split()[0]
        PAGES += [
            f'<html><body><header><h2>The site</h2><p>{_fill}</p></header><{_box}><p>{_fill}</p></{_end}><article y="1"><h1>Title of it</h1><p>{_fill}</p><p>Yes.</p></article><footer>&copy; site &middot; {_fill}</footer></body></html>',
            f'<html><body><nav><ul>{_MENU}</ul></nav><main y="1"><h1>Title</h1><p>{_fill}</p><ul><li>A point.</li><li>{_fill}</li></ul><{_box} y="0"><h3>Box</h3><p>{_fill}</p></{_end}><p>{_LONG}</p></main><footer><p>{_fill}</p></footer></body></html>',
            f'<html><body><div class="header">{_fill}</div><{_box}>{_fill}<ul>{_MENU}</ul></{_end}><div class="content" y="1"><p>{_LONG}</p><div><p>{_fill}</p></div></div><div class="footer">{_fill}</div></body></html>',
        ]

# Articles with a header of their own, lists of references that are links, and named boxes inside that are none of the text.
_REFERENCES = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("a source", "another work", "the report of the year"))
_SHARE = '<div class="shareButtons" y="0"><a href="#">Tweet</a> <a href="#">Mail</a></div>'
_TAGS = '<div class="related" y="0"><h3>More</h3><ul><li><a href="/a">A story</a></li><li><a href="/b">And one more</a></li></ul></div>'
for _title in ("<h1>A heading</h1>", "<h2>The heading of it</h2><p>By ann, in May</p>", '<h1><a href="/it">A heading that is a link</a></h1>'):
    for _list in (f"<ul>{_REFERENCES}</ul>", f"<h2>References</h2><ol>{_REFERENCES}</ol>", '<p><a href="/s">See the source</a></p>'):
        PAGES += [
            f'<html><body><header><a href="/">The site</a><nav><ul>{_MENU}</ul></nav></header><article y="1"><div class="entry-header">{_title}</div><p>{_LONG}</p>{_list}<p>{_LONG}</p></article><footer><ul>{_MENU}</ul></footer></body></html>',
            f'<html><body><nav>{_MENU}</nav><main y="1"><article><header>{_title}</header>{_SHARE}<p>{_LONG}</p>{_list}</article>{_TAGS}</main><aside><ul>{_REFERENCES}</ul></aside></body></html>',
            f'<html><body><div class="siteHeader"><ul>{_MENU}</ul></div><div class="articleBody" y="1">{_title}<p>{_LONGER}</p>{_list}<div class="userComments" y="0"><p>{_LONG}</p></div></div><div class="pageFooter">{_LONG}</div></body></html>',
        ]
