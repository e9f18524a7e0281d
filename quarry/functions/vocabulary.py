"""Fixed values of the rules: word lists, patterns, weights and vocabularies."""

# fixed values: query parameters that only track
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "dclid", "msclkid",
    "mc_cid", "mc_eid", "igshid", "si", "ref_src", "ref_url", "ref", "spm", "scm",
]

# fixed values: public suffixes of two labels
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "co.nz", "net.nz", "org.nz", "com.br", "com.mx",
    "com.ar", "co.jp", "ne.jp", "or.jp", "com.cn", "org.cn", "co.in", "co.za", "com.sg", "com.tr", "com.tw",
]

# fixed values: hosts that are reserved for tests
RESERVED_SUFFIXES = ["example", "test", "invalid", "localhost", "local"]

# fixed values: link patterns and weights
LINK_WEIGHTS = [
    (r"music[-_]?submissions?", 10), (r"submit([-_]?music|[-_]?your[-_]?music)?", 10), (r"submission", 9), (r"program[-_]?director", 8),
    (r"contact([-_]?us)?", 8), (r"\bcontact\b", 7), (r"playlist|airplay", 6), (r"programming", 6), (r"\bmusic\b", 5),
    (r"\bstaff\b|\bteam\b|\bpeople\b", 5), (r"\bdj?s?\b|on[-_]?air personalities|hosts?", 4), (r"advert(ise|ising)", 3),
    (r"\babout\b", 2), (r"\bshows?\b|\bschedule\b", 1),
]

# fixed values: role patterns in order
ROLE_RULES = [
    (r"music\s*director", "music_director"),
    (r"assistant\s*music\s*director", "music_director"),
    (r"program\s*director", "program_director"),
    (r"programming\s*director", "programming"),
    (r"director\s*of\s*programming", "programming"),
    (r"music\s*(programmer|scheduler|coordinator)", "music_programmer"),
    (r"(music|demo|song|track)s?\s*(submissions?|to:)", "music_submission"),
    (r"submit\s+(your\s+)?(music|tracks|demos|songs)", "music_submission"),
    (r"send\s+us\s+your\s+music", "music_submission"),
    (r"station\s*manager", "station_manager"),
    (r"general\s*manager", "station_manager"),
    (r"media\s*(contact|inquiries|enquiries|relations)|press\s*(contact|inquiries|kit)|public\s*relations", "media"),
    (r"bookings?\b|event\s*requests?", "booking"),
    (r"\bproducer\b", "producer"),
    (r"(radio\s+)?host\b|presenter\b|on[- ]air\s*(host|personality)", "host"),
    (r"(\bdj\b|\bdjs\b)", "dj"),
    (r"general\s*(inquiries|enquiries|questions)", "general"),
    (r"advert(ising|isements?|ertise)?|underwriting|sponsorships?", "advertising"),
]
# fixed values: roles that decide on music, the first ones first
DECISION_ROLES = ["music_director", "program_director", "music_programmer", "music_submission", "programming", "music_scheduler", "music_coordinator"]
MUSIC_ROLES = ["music_director", "music_submission", "programming", "music_programmer", "program_director"]

# fixed values: e-mail
FREE_PROVIDERS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "live.com", "msn.com", "me.com", "comcast.net"]
FREE_PROVIDERS_OF_CONTACTS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "live.com", "msn.com"]
ROLE_INBOXES = [
    "info", "music", "md", "pd", "apd", "programming", "musicdirector", "musicdirector@", "programdirector", "programdirector2", "submissions",
    "submit", "submission", "musicdepartment", "office", "admin", "administrator", "contact", "hello", "general", "reception", "news",
    "frontdesk", "operations", "manager",
]

# fixed values: station types in tie-break order
STATION_TYPES = [
    ("college", ["college radio", "college station", "student radio", "student-run"]),
    ("university", ["university radio", "university station"]),
    ("campus", ["campus radio", "campus station", "campus and community"]),
    ("community", ["community radio", "community station", "listener-supported", "non-commercial community"]),
    ("public", ["public radio", "npr", "npr member", "pacifica"]),
    ("independent", ["independent radio", "indie radio", "independently owned and operated", "independently operated"]),
    ("internet", ["internet radio", "online radio", "web radio", "internet-only"]),
]

# fixed values: genres and formats
GENRES = [
    ("afrobeat", ["afrobeat", "afrobeats"]), ("amapiano", ["amapiano"]), ("hip_hop", ["hip-hop", "hip hop", "rap"]),
    ("r_and_b", ["r&b", "rhythm and blues", "rnb"]), ("jazz", ["jazz"]), ("blues", ["blues"]),
    ("country", ["country music", "country western"]), ("classical", ["classical music", "classical"]),
    ("rock", ["rock music", "classic rock", "indie rock"]), ("pop", ["pop music", "top 40", "chr"]), ("reggae", ["reggae"]),
    ("dancehall", ["dancehall"]), ("gospel", ["gospel"]),
    ("electronic", ["electronic music", "edm", "dance music", "house music", "techno"]),
    ("latin", ["latin music", "salsa", "cumbia", "reggaeton"]), ("folk", ["folk music", "americana", "bluegrass"]), ("metal", ["metal"]),
    ("punk", ["punk"]), ("soul", ["soul music", "motown"]), ("funk", ["funk"]), ("world", ["world music", "global sounds"]),
    ("indie", ["indie music", "independent artists"]),
]
FORMATS = [
    ("music", ["music radio", "music programming", "playing music", "music format"]),
    ("talk", ["talk radio", "talk show", "talk programming", "discussion"]),
    ("news", ["news radio", "news and information", "local news", "news talk"]),
    ("sports", ["sports radio", "sports talk", "live sports"]),
    ("variety", ["variety of music", "eclectic", "freeform"]),
]

# fixed values: restrictions on submissions
RESTRICTIONS = [
    ("no_attachments", r"no\s+(?:email\s+)?attachments?"),
    ("digital_only", r"(?:mp3|digital|links?)\s+only|only\s+(?:accept|via)\s+(?:mp3|digital|links?)"),
    ("no_phone_calls", r"no\s+phone\s+calls?"),
    ("postal_only", r"(?:postal|physical)\s+(?:mail|copies)\s+only|by\s+mail\s+only"),
    ("no_drop_ins", r"no\s+drop[- ]ins?"),
    ("review_window", r"(?:allow|please allow|within)\s+\S*\s*(?:weeks?|days?)\s*(?:for|to)\s+(?:a\s+)?review"),
]

# fixed values: strength of evidence by type of source
SOURCE_STRENGTH = {
    "official_website_page": 4, "official_website_mailto": 3, "submission_page": 3, "contact_page": 2, "official_source": 4,
    "directory_source": 1, "public_directory": 1, "social_source": 0, "search_source": 0,
}
OUTCOMES = ["corroborated", "conflicting", "single_source", "unobserved"]
VERIFICATION_STATES = ["unverified", "verified", "conflicting", "unsupported", "stale", "failed"]
MAX_AGE_DAYS = 90

# fixed values: opportunity scoring, in hundredths
OPPORTUNITY_WEIGHTS = {"route": 22, "contact": 17, "genre": 13, "record": 13, "identity": 9, "format": 8, "location": 6, "release": 12}
ROUTE_PRIORITY_SCORE = {1: 1.0, 2: 0.75, 3: 0.5, 4: 0.3}
CONTACT_LEVEL_SCORE = {1: 1.0, 2: 0.85, 3: 0.6, 4: 0.45, 5: 0.4}
HIGH, MEDIUM, CONTACTED_PENALTY = 70, 40, 12

# fixed values: outreach
OUTREACH_STATUSES = ["ready", "sent", "responded", "follow_up", "failed", "closed"]

# fixed values: candidates that are no performer's page
LISTING_HOSTS = [
    "eventbrite", "ticketmaster", "songkick", "seatgeek", "eventful", "dice.", "dice.fm", "lu.ma", "meetup.", "biletix", "enterticket",
    "ra.co", "residentadvisor", "yelp.", "yellowpages", "eventnoire",
]
LISTING_PATHS = ["/events", "/event/", "/tickets", "/ticketing", "/date/", "/playlist", "/sets", "/shows", "/tour/", "/gigs", "/search"]
FORUM_PATHS = ["/groups/", "/posts/", "/videos/"]
LISTING_TEXTS = [
    "buy tickets", "get tickets", "tickets on sale", "tickets", "ticketing", "rsvp", "register now", "eventbrite", "what's on", "things to do",
    "upcoming events", "event listing", "event calendar", "events calendar", "concert listing", "concerts in", "gigs in", "gig listings",
    "gig guide", "tour dates", "line-up", "lineup", "playlist", "playlists", "mixtape",
]
PROFILE_HOSTS = ["mixcloud.com", "soundcloud.com"]
PERFORMER_TEXTS = [
    "dj bookings", "booking this dj", "book this dj", "hire a dj", "hire this dj", "dj services", "club dj", "wedding dj", "resident dj",
    "radio host", "selecta", "selector", "turntablist", "turntablism", "dj mixes", "studio mix", "deejay", "dee-jay",
]
PERFORMER_LEADS = ["dj ", "dj,", "dj|", "dj·", "dj —", "dj -", "deejay ", "dee-jay ", "selecta ", "selector ", "resident dj ", "club dj "]

# fixed values: candidates that are no station's site
PLATFORM_HOSTS = [
    "facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "linkedin.com", "pinterest.com", "reddit.com", "tumblr.com",
    "youtube.com", "youtu.be", "vimeo.com", "twitch.tv", "wikipedia.org", "wikimedia.org", "wikidata.org", "fandom.com", "spotify.com",
    "soundcloud.com", "mixcloud.com", "bandcamp.com", "apple.com", "deezer.com", "pandora.com", "audacy.com", "discogs.com", "last.fm",
    "allmusic.com", "genius.com", "azlyrics.com", "lyrics.com", "songfacts.com", "amazon.com", "ebay.com", "etsy.com", "yelp.com",
    "tripadvisor.com", "eventbrite.com", "ticketmaster.com", "stubhub.com", "songkick.com", "bandsintown.com", "seatgeek.com", "dice.fm",
    "tunein.com", "streema.com", "radio.com", "iheart.com", "radio-garden.com", "onlineradiobox.com", "mytuner-radio.com", "radios.com",
    "radio-uk.co.uk", "radioline.co", "indeed.com", "glassdoor.com", "ziprecruiter.com", "monster.com", "linktr.ee", "patreon.com",
    "gofundme.com", "change.org",
]
ITEM_PATH = (
    r"(?i)^/(?:playlist|playlists|song|songs|lyrics|album|albums|artist|artists|news|article|articles|story|stories|press-release|event|events|"
    r"tickets?|tour|concerts?|jobs?|careers?|vacanc|wiki|shop|store|cart|checkout|product|products|watch|video|videos|tag|tags|category|"
    r"categories|author|authors|review|reviews|top-?\d+)(?:/|$)"
)
OTHER_TEXT = (
    r"(?i)\b(top\s+\d+\s+songs?|playlist|lyrics|album review|concert tickets?|tour dates|buy tickets|wikipedia|now hiring|jobs? in|job opening|"
    r"for sale|buy now|add to cart|listen online free|online radio stations?\s+(?:list|directory)|radio station jobs?|download mp3|free download)\b"
)
STATION_WORDS = (
    r"(?i)\b(radio|radio station|broadcast(?:ing)?|community radio|public radio|college radio|campus radio|pirate radio|low[- ]power|airwaves|"
    r"on air|fm|am)\b"
)
CALLSIGN = r"\b(?:W|K|C|X)[A-Z]{2,4}\b"
FREQUENCY = r"(?i)\b\d{2,3}(?:\.\d{1,2})?\s?(?:fm|am|khz|mhz)\b"
