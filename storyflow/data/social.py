"""Fixed values of the rules on posts: each list must hold just these, in any use."""

#: Tags that begin or end a line of text.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "br", "div", "dl", "dt", "dd", "figcaption", "figure", "footer",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul",
)

#: Places that become tags.
PLACES = (
    "Gainsborough", "Lincoln", "Scunthorpe", "Grimsby", "Cleethorpes", "Boston", "Skegness", "Spalding", "Grantham", "Sleaford",
    "Stamford", "Louth", "Horncastle", "Market Rasen", "Mablethorpe", "Bourne", "Woodhall Spa", "Brigg", "Barton upon Humber",
    "Immingham",
)

#: The authority of a place, where it becomes a tag too.
AUTHORITIES = {
    "gainsborough": "WestLindsey", "market rasen": "WestLindsey", "lincoln": "Lincoln", "scunthorpe": "NorthLincolnshire",
    "brigg": "NorthLincolnshire", "barton upon humber": "NorthLincolnshire", "grimsby": "NorthEastLincolnshire",
    "cleethorpes": "NorthEastLincolnshire", "immingham": "NorthEastLincolnshire", "boston": "Boston", "skegness": "EastLindsey",
    "louth": "EastLindsey", "horncastle": "EastLindsey", "mablethorpe": "EastLindsey", "spalding": "SouthHolland",
    "grantham": "SouthKesteven", "stamford": "SouthKesteven", "bourne": "SouthKesteven", "sleaford": "NorthKesteven",
}

#: Words of a topic, and its tag.
TOPICS = (
    (("cinema", "film"), "Cinema"),
    (("planning", "development", "housing"), "Planning"),
    (("council", "councillor"), "LocalDemocracy"),
    (("business", "shop", "retail"), "Business"),
    (("event", "festival", "concert", "show"), "WhatsOn"),
    (("police", "crime", "court"), "LincolnshirePolice"),
    (("fire", "firefighter"), "LincolnshireFire"),
    (("football", "sport", "match"), "LincolnshireSport"),
    (("heritage", "history", "historic"), "LincolnshireHistory"),
)

#: What a venue's name ends with.
VENUE_ENDINGS = (
    "Cinema", "Theatre", "Museum", "Gallery", "Market", "Hospital", "University", "College", "School", "Academy", "Club",
    "Centre", "Center", "Hall", "Castle", "Cathedral", "Park", "Stadium",
)

#: Tags that end every list.
CLOSING_TAGS = ("Lincolnshire", "Lincolnshire News", "Local News")

#: Terms by which a post gets its marks; each counts wherever it stands, within a word too.
SENSITIVE_TERMS = (
    "death", "died", "fatal", "killed", "murder", "manslaughter", "rape", "sexual assault", "domestic abuse", "missing child",
    "serious injury", "life-threatening", "terrorism", "bereaved", "funeral",
)
COMMUNITY_TERMS = ("community", "event", "engagement", "patrol", "prevention", "advice", "volunteer", "school", "reassurance", "neighbourhood")
COURT_TERMS = ("charged", "court", "magistrates", "crown court", "jailed", "sentenced", "convicted", "remanded", "pleaded guilty")
ROAD_TERMS = ("collision", "road", "vehicle", "driver", "motorist", "car", "van", "motorcycle", "motorbike")
APPEAL_TERMS = ("appeal", "witness", "information", "recognise", "recognize", "come forward", "contact police")
ARREST_TERMS = ("arrested", "arrest", "detained", "custody")
DRUG_TERMS = ("cannabis", "cocaine", "heroin", "drug", "drugs", "county lines")

#: The marks of a post by the role they play, for sensitive stories, those of a community, and others.
SENSITIVE_MARKS = (("headline", "🚨"), ("location", "📍"), ("investigation", "🔎"), ("court", "⚖️"), ("appeal", "📢"), ("police", "🚔"), ("information", "ℹ️"), ("news", "📰"))
COMMUNITY_MARKS = (("headline", "📣"), ("location", "📍"), ("community", "🤝"), ("police", "👮"), ("area", "🏘️"), ("information", "ℹ️"), ("news", "📰"), ("positive", "✅"))
OTHER_MARKS = (("headline", "🚔"), ("location", "📍"), ("investigation", "🔎"), ("court", "⚖️"), ("appeal", "📢"), ("information", "ℹ️"), ("news", "📰"), ("positive", "✅"))

#: Terms that change the mark of the first of two roles that the story has, in this order.
MARK_CHANGES = (
    (ROAD_TERMS, "investigation", "headline", "🚗"),
    (COURT_TERMS, "court", "information", "⚖️"),
    (APPEAL_TERMS, "appeal", "information", "📢"),
    (ARREST_TERMS, "police", "investigation", "🚔"),
    (DRUG_TERMS, "investigation", "information", "🔎"),
)

#: The role whose mark a paragraph gets, by its terms: the first that the story has and no paragraph before had.
PARAGRAPH_ROLES = (("court", COURT_TERMS), ("appeal", APPEAL_TERMS), ("investigation", DRUG_TERMS + ARREST_TERMS), ("community", COMMUNITY_TERMS), ("police", ARREST_TERMS))
