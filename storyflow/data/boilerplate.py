"""Fixed values of page furniture."""

from __future__ import annotations

#: Lines that are never a story's text.
BOILERPLATE_LINES = (
    "main article content", "main content", "article content", "news", "latest news", "published", "published:", "updated", "updated:", "share",
    "share this article", "share this page", "back to news", "back to top", "skip to main content", "skip to content", "print this page", "download", "listen", "related stories",
    "related news", "more news", "contact us", "follow us", "subscribe", "sign up", "image", "main image", "copyright", "privacy",
    "cookies", "accessibility", "menu", "search", "home",
)

#: Fixed patterns: lines of a page that are no copy of its article.
ARTICLE_FURNITURE = (
    r"^\s*subscribe\b", r"^\s*sign up\b", r"^\s*read more\b", r"^\s*related (?:articles|stories|posts|content)\b", r"^\s*(?:you may also like|more from|recommended for you)\b", r"^\s*follow us\b",
    r"^\s*share this\b", r"^\s*share (?:on|via|to)\b", r"^\s*(?:facebook|twitter|x|linkedin|whatsapp|email)\s*$", r"^\s*(?:share|tweet|pin|send|print)\s*$", r"^\s*like this:?\s*$",
    r"^\s*loading(?:\.\.\.)?\s*$", r"^\s*advertisement\b", r"^\s*cookie\b", r"^\s*comments?\b", r"^\s*leave a (?:reply|comment)\b", r"^\s*posted (?:in|on|by)\b",
    r"^\s*(?:previous|next) (?:article|post|story)\b", r"^\s*tags?:\s*", r"^\s*categories?:\s*", r"^\s*opens? in (?:a )?new window\b", r"^\s*copy link\b",
)

#: Fixed patterns: paragraphs of an interface's answer that are no copy of its article.
ANSWER_FURNITURE = (
    r"^advertisement\b", r"^(?:buy|book) tickets?\b", r"^related (?:articles|stories|news)\b", r"^(?:sign up|subscribe)\b", r"^share (?:this|on|via)\b", r"^created by\s*:", r"^posted in\s*:",
)

#: What an address of a video, or of its preview, holds.
VIDEO_TERMS = (
    "youtube.com", "youtu.be", "vimeo.com", "brightcove", "dailymotion", "video-thumbnail", "video_thumbnail", "videothumb", "video-poster", "video_poster", "/video/", "play-button", "play_button", "sprite", "tracking", "pixel",
)

#: Short texts that are never a paragraph, besides the lines above.
FURNITURE_PHRASES = (
    "main article content", "skip to main content", "accept all cookies", "manage cookie preferences", "share this article", "share this page", "back to news", "sign up for updates",
    "subscribe to our newsletter", "follow us on facebook", "follow us on twitter", "follow us on x", "opens in a new window", "external link",
)

#: Fixed patterns: a paragraph that is but a label, an image file's name, a date, a time, a network's name or a link to a neighbour.
FURNITURE_WHOLE = (
    r"(?:published|updated|author|source|news|image|caption|location|category|tags)\s*:",
    r"[^\n]*?\.(?:jpg|jpeg|png|gif|webp|svg|bmp|tif|tiff)(?:\?.*)?",
    r"(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}|\d{1,2}\s+(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{4})",
    r"\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?",
    r"(?:facebook|twitter|x|instagram|linkedin|email|whatsapp)",
    r"(?:previous|next|previous\s+article|next\s+article)",
)

#: What is never a story's place, and what is never its category.
NO_PLACES = (
    "main article content", "article content", "main content", "news", "latest news", "published", "published:", "police news",
    "nottinghamshire police", "source", "main image", "image", "unknown", "none", "n/a",
)
NO_CATEGORIES = ("main article content", "article content", "main content", "news", "latest news", "published", "published:", "source", "main image", "image")
