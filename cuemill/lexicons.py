"""Default lexicons. Every function takes its lexicon as an argument; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Cues matched as substrings (baseline labels and the annotation sample).
SUBSTRING_CUES = (
    "may", "might", "could", "likely", "unlikely", "possibly",
    "expects", "expect", "forecast", "project", "anticipate",
    "suggests", "appears", "seems", "believe", "estimates",
    "probable", "potential", "could see", "may see", "risk",
    "uncertain", "indicate", "signals",
)

# Cues matched as whole tokens (external news) or between word boundaries (training).
KEYWORD_CUES = (
    "may", "might", "could", "would", "possibly", "perhaps",
    "likely", "unlikely", "appear", "seem", "suggest", "indicate",
    "estimate", "forecast", "expect", "expected", "project", "potential",
    "approximately", "around", "about", "roughly", "believed", "appears",
    "seems", "reported", "reportedly", "alleged", "allegedly", "rumored",
    "speculation", "speculate", "anticipated", "probably", "presumably",
    "poised", "set to", "plans to", "aims to", "seeks to", "intends",
)

# Regular expressions that pick candidate sentences for annotation.
CANDIDATE_PATTERNS = (
    r"\bmay\b", r"\bmight\b", r"\bcould\b", r"\bpossibly\b", r"\bpotentially\b",
    r"\blikely\b", r"\bunlikely\b", r"\bappears\b", r"\bseems\b", r"\bsuggests\b",
    r"\bindicates\b", r"\bestimates?\b", r"\bexpected\b", r"\bprojected\b",
    r"\buncertain\b", r"\brisk\b", r"\bdepends on\b",
)

# Junk sentences of the curated corpus, found anywhere unless anchored.
CORPUS_JUNK = (
    r"Got a confidential news tip", r"Subscribe today", r"Taken from CNBC", r"Daily Open",
    r"newsletter", r"CNBC.?s Daily Open", r"CNBC.?s international markets newsletter",
    r"Analyst.?s Disclosure", r"Seeking Alpha", r"Past performance is no guarantee",
    r"Our analysts are third party authors", r"Any views or opinions expressed",
    r"I wrote this article myself", r"I/we have a beneficial", r"Disclosure:",
    r"Read here for the full list", r"Check out the companies making the biggest moves",
    r"-- CNBC.?s.*contributed to this report",
    r"^WATCH:", r"^WATCH\b", r"WATCH:",
    r"^LONDON —", r"^NEW YORK —", r"^HONG KONG —",
    r"^Got a confidential", r"^U\.S\. futures are mostly flat",
    r"^The stock market will close early",
)

# The merge of external news lets a bare "WATCH:" inside a sentence pass.
MERGE_JUNK = tuple(p for p in CORPUS_JUNK if p != r"WATCH:")

# Junk sentences of the training set.
TRAINING_JUNK = (
    r"^Sign up", r"^Subscribe", r"^Click here", r"views and opinions",
    r"not necessarily reflect", r"Disclosure Policy", r"^More Stock Market News",
    r"^You can see more", r"^On the date of publication",
)

# Where boilerplate starts; the rest of the line is cut.
TRUNCATE_PATTERNS = (
    r"Global Business and Financial News", r"Data is a real-time snapshot",
    r"Read more aboutcookies", r"© 20\d\d", r"Unauthorized distribution",
    r"Subscribe now", r"By continuing to use our site", r"Advertisement", r"Continue reading",
)

# Phrases that make a whole paragraph boilerplate.
PARAGRAPH_JUNK = (
    "Subscribe now", "Sign up", "Sign up for free", "Get this delivered",
    "By continuing to use our site", "Advertisement", "Continue reading",
    "Global Business and Financial News", "Data is a real-time snapshot",
    "Read more aboutcookies", "Unauthorized distribution",
    "You can manage saved articles", "©",
)

# Relevance terms, three points each (five when also in the title).
STRONG_TERMS = (
    "stock", "stocks", "equity", "equities", "shares", "market",
    "s&p 500", "s&p", "dow jones", "dow", "nasdaq", "russell",
    "earnings", "eps", "revenue", "guidance", "forecast",
    "price target", "analyst rating", "upgrade", "downgrade",
    "ipo", "stock split", "dividend", "buyback",
    "volatility", "vix", "options", "futures",
    "bull market", "bear market", "correction", "crash",
)

# Relevance terms, one point each.
MODERATE_TERMS = (
    "index", "indexes", "indices", "bond", "bonds", "yield",
    "treasury", "treasuries", "fed", "federal reserve",
    "rate cut", "rate hike", "interest rate", "inflation",
    "gdp", "cpi", "ppi", "unemployment",
    "rally", "selloff", "decline", "surge", "plunge",
    "trading", "investor", "investors", "valuation",
    "sector", "hedge fund", "mutual fund", "etf",
)

# Company suffixes, one point once.
COMPANY_SUFFIXES = ("inc", "corp", "ltd", "plc", "llc")


@dataclass(frozen=True)
class Exclusion:
    """Reject a text holding one of ``triggers``, unless one of ``unless`` follows on that line."""

    triggers: tuple[str, ...]
    unless: tuple[str, ...] = ()


# Hard exclusions of the relevance score.
EXCLUSIONS = (
    Exclusion(("deal", "deals", "coupon", "discount", "sale", "black friday", "cyber monday",
               "gift guide", "shopping")),
    Exclusion(("recipe", "recipes", "fashion", "lifestyle", "beauty", "travel", "hotel",
               "restaurant")),
    Exclusion(("salary", "compensation", "ceo pay", "benefits", "hiring"),
              ("disclose", "report", "filing")),
    Exclusion(("review", "guide", "how to", "tips for"), ("invest", "stock", "trading")),
    Exclusion(("movie", "film", "game", "gaming", "sports", "music", "celebrity"),
              ("stock", "share", "ipo")),
)

# The news query (any of, none of) and the domains it is sent to.
QUERY_ANY = ("stock market", "equity market", "earnings", "shares", "volatility", "IPO",
             "price target")
QUERY_NONE = ("recipe", "coupon", "deal")
QUERY_DOMAINS = ("cnbc.com", "marketwatch.com", "finance.yahoo.com", "reuters.com",
                 "seekingalpha.com")

# The feed check's domains and topic words.
ALLOWED_DOMAINS = ("marketwatch.com", "reuters.com", "cnbc.com", "finance.yahoo.com",
                   "bloomberg.com", "businessinsider.com", "financialpost.com")
TOPIC_KEYWORDS = ("apple", "microsoft", "amazon", "google", "alphabet", "nvidia", "tesla", "chip",
                  "semiconductor", "ai", "earnings", "cloud", "meta", "intel", "salesforce")

# Names under which external news tables carry their text, in order of preference.
TEXT_COLUMNS = ("Article_title", "article_title", "title", "Title", "Article", "article", "text",
                "Text", "content", "headline", "Headline", "sentence", "news_title")

# Column variants and the canonical name they take; the first one present wins.
COLUMN_VARIANTS = {
    "date": ("Date", "date", "Date_string"),
    "stock_symbol": ("Stock_symbol", "stock_symbol", "symbol"),
    "publisher": ("Publisher", "publisher"),
    "url": ("Url", "url"),
}


@dataclass(frozen=True)
class RelevanceLexicon:
    """All word lists of the relevance score."""

    strong: tuple[str, ...] = STRONG_TERMS
    moderate: tuple[str, ...] = MODERATE_TERMS
    suffixes: tuple[str, ...] = COMPANY_SUFFIXES
    exclude: tuple[Exclusion, ...] = EXCLUSIONS
