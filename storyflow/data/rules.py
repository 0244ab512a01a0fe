"""Fixed values of the rules on articles, pages and images: each list must hold just these, in any use."""

#: Lines that a scraper leaves in a text, as comparison keys see them.
SCRAPE_NOISE = (
    "main article content", "article content", "main content", "news", "latest news", "published:", "share this article",
    "share this page", "related articles", "related news", "subscribe", "sign up", "advertisement",
)

#: What such a line starts with.
NOISE_PREFIXES = (
    "subscribe to ", "sign up to ", "sign up for ", "follow us on ", "read more:", "related:", "image:", "photo:", "picture:", "copyright:",
)

#: Titles of links that are no articles.
EXCLUDED_TITLES = (
    "home", "read more", "view", "more", "next", "previous", "contact us", "about us", "privacy policy", "join the club",
    "find out more", "latest news", "news", "events", "gallery", "menu", "about", "committee", "membership", "contact",
    "privacy", "accessibility", "policies", "downloads", "fixtures", "results", "tables",
)

#: Parts of an article's address.
ARTICLE_URL_PARTS = ("/news/", "/latest/", "/story/", "/article/", "/blog/", "/event/", "/match-report/", "/race-report/")

#: Words in an address that speak against an article, and by how much.
URL_PENALTIES = (
    ("login", -100), ("register", -100), ("membership", -100), ("committee", -100), ("contact", -100), ("privacy", -100),
    ("accessibility", -100), ("safeguarding", -100), ("policies", -100), ("policy", -100), ("history", -100), ("calendar", -80),
    ("fixtures", -80), ("results", -80), ("tables", -80), ("downloads", -80), ("pdf", -80), ("sponsors", -50), ("shop", -50),
    ("volunteers", -50),
)

#: What a summary that says nothing starts with.
BLOCKED_SUMMARIES = (
    "allow youtube content", "this page contains content provided by", "we need your permission", "you can use your browser settings",
    "we're not responsible for the content of external sites", "we are not responsible for the content of external sites",
    "sorry, there was a technical problem", "please try again", "watch the video", "share this page", "sign up", "subscribe",
    "image caption", "image credit", "photo credit", "picture credit", "read more", "related content", "main article content",
)

#: What the address of a decoration holds.
DECORATIONS = ("logo", "icon", "avatar", "emoji", "sprite", "badge", "crest", "favicon", "tracking", "pixel")

#: What the classes and ids of an article's container hold, and those of page furniture.
POSITIVE_KEYWORDS = ("article", "articlebody", "article-body", "story", "content", "entry", "post", "main", "body")
NEGATIVE_KEYWORDS = (
    "share", "sharing", "social", "comment", "related", "recommend", "sidebar", "widget", "advert", "promo", "newsletter",
    "subscription", "subscribe", "modal", "popup", "overlay", "footer", "nav", "navigation", "cookie",
)

#: Parts and endings of addresses that are no articles; a part that begins with a slash ends with a word's end.
EXCLUDED_URL_PARTS = (
    "#", "javascript:", "mailto:", "tel:", "/contact", "/about", "/privacy", "/terms", "/cookie", "/login", "/sign-in", "/membership",
    "/shop", "/gallery", "/sponsors", "/safeguarding",
)
EXCLUDED_URL_ENDINGS = (
    "/about", "/contact", "/privacy", "/accessibility", "/history", "/committee", "/join", "/shop", "/calendar", "/results",
    "/fixtures", "/tables",
)

#: Lines of a record's page that belong to the site, and what such lines start with.
DETAIL_UI_LINES = ("advanced search", "all", "story", "advisory", "download text", "download images", "log out")
DETAIL_PREFIXES = ("slug:", "by:", "author's email:", "last reviewed by email:", "created at:", "modified at:")
