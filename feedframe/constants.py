"""Fixed values of the record format: keys, codes, phrases and limits.

Everything in this file is data that results depend on, kept together so that it
can be read (and overridden) in one place.
"""

from __future__ import annotations

BASE_URL = "https://www.instagram.com/"

# ---- stored API responses --------------------------------------------------
# A response belongs to the API when its URL starts with one of
# these. The first has no trailing slash on purpose.
API_PREFIXES = (
    "https://www.instagram.com/api/graphql",
    "https://www.instagram.com/api/v1",
    "https://www.instagram.com/graphql",
)
API_RESOURCE_TYPE = "xhr"

# Keys of payloads and names of node types.
HOME_FEED_KEY = "xdt_api__v1__feed__timeline__connection"
USER_FEED_KEY = "xdt_api__v1__feed__user_timeline_graphql_connection"
SHORTCODE_KEY = "xdt_api__v1__media__shortcode__web_info"
SEARCH_KEY = "xdt_fbsearch__top_serp_graphql"
CHAINING_KEY = "xdt_api__v1__discover__chaining"
PROFILE_KEY = "user"
CONNECTION_KEYS = (HOME_FEED_KEY, USER_FEED_KEY, SEARCH_KEY)

IGNORE_FIRST_KEYS = ("xdt_notification_badge", "lightspeed_web_request_for_igd")
IGNORE_LAST_KEYS = ("highlights", "xdt_get_inbox_tray_items")

MEDIA_TYPENAME = "XDTMediaDict"
FEED_ITEM_TYPENAME = "XDTFeedItem"
SEARCH_GRID_TYPENAME = "XDTTopSerpMediaGridUnit"

# Phrases that mark an error message as throttling.
RATE_LIMIT_PHRASES = (
    "wait a few minutes",
    "try again later",
    "rate limit",
    "please wait",
)

# ---- requests and runs -----------------------------------------------------
# What each endpoint has to be asked with.
REQUIRED_QUERY_KEYS = {
    "UserTimeline": ("handle", "start_date", "end_date"),
    "UserProfile": ("handle",),
    "PostByShortcode": ("shortcode",),
    "Chaining": ("handle",),
    "Search": ("keyword",),
}

# Result codes.
RELOAD = "something went wrong - reload"
END_OF_FEED = "scraped until first ever post was reached"
REACHED_START = "scraped until user-specified starting date was reached"
SUCCESS = "success"
MAX_PAGES = "max_paginations_reached"
SHAPE_ERROR = "response_shape_error"
NO_POSTS = "no posts"
PRIVATE = "account is private"
UNAVAILABLE = "profile is not available"
FAILED_TO_LOAD = "failed to load"
TIMEOUT = "timeout error"
LOGGED_OUT = "logged out while scraping"

# Result code -> category.
RESULT_CATEGORIES = {
    SUCCESS: "success",
    REACHED_START: "success",
    END_OF_FEED: "success",
    NO_POSTS: "success",
    PRIVATE: "success",
    UNAVAILABLE: "success",
    MAX_PAGES: "success",
    "bad internet": "retry",
    TIMEOUT: "retry",
    RELOAD: "retry",
    FAILED_TO_LOAD: "retry",
    "target crashed": "crash",
    LOGGED_OUT: "crash",
    SHAPE_ERROR: "partial",
}
# Success codes of a timeline run that carries no posts to filter.
EMPTY_TIMELINE_CODES = (NO_POSTS, PRIVATE, UNAVAILABLE)

# Limits of a paging.
NO_PROGRESS_LIMIT = 5
PAGE_CAPS = {"UserTimeline": 5000, "Search": 2000}

# ---- files -----------------------------------------------------------------
# Extensions.
DOCUMENT_EXTENSIONS = (".json", ".json.gz")
LINE_EXTENSIONS = (".jsonl", ".jsonl.gz", ".ndjson", ".ndjson.gz")
INPUT_EXTENSIONS = DOCUMENT_EXTENSIONS + LINE_EXTENSIONS
OUTPUT_SUFFIXES = {"csv": ".csv", "jsonl": ".jsonl", "parquet": ".parquet"}

IMAGE_EXTENSIONS = (".jpg", ".png", ".heic", ".webp")

# ---- stored page text ------------------------------------------------------
# Phrases of visited pages.
TEXT_UNAVAILABLE = "Profile isn't available"
TEXT_SORRY = "Sorry, this page isn't available"
TEXT_PRIVATE = ("This account is private", "account is private")
TEXT_RETRY = "Retry"
TEXT_FAILED = "Failed to Load"
TEXT_NO_POSTS = "No Posts Yet"
