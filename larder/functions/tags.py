"""Controlled vocabulary: tag slugs, categories and content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import let, strip

# Fixed values -----------------------------------------------------------------------
CATEGORIES = """
    food-cooking fitness-health travel technology software-engineering ai-ml design business-finance
    education-learning science news-politics entertainment music art-culture sports fashion-beauty home-diy
    nature-outdoors gaming lifestyle productivity shopping-products humor-memes other""".split()
CONTENT_TYPES = """
    recipe workout tutorial explainer review listicle news-report interview vlog documentary comedy performance
    product-demo announcement opinion case-study tool-showcase travel-guide article discussion meme reference
    other""".split()
ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "ml": "machine-learning", "dl": "deep-learning",
    "llm": "llms", "large-language-model": "llms", "large-language-models": "llms", "ai": "artificial-intelligence",
    "genai": "generative-ai", "k8s": "kubernetes", "postgres": "postgresql", "psql": "postgresql", "pg": "postgresql",
    "react-js": "react", "reactjs": "react", "nodejs": "node", "node-js": "node", "nextjs": "next-js",
    "swiftui": "swift-ui", "ios-development": "ios", "workout-routine": "workout", "gym": "fitness",
    "recipes": "recipe", "cooking-tips": "cooking", "italian-food": "italian-cuisine", "vector-db": "vector-database",
    "vector-databases": "vector-database", "rag": "retrieval-augmented-generation", "embedding": "embeddings",
}
NOISE = """
    fyp fy foryou foryoupage for-you for-you-page viral viralvideo viral-video trending trend trendingreels explore
    explorepage explore-page instagram insta instagood instadaily reels reel reelsinstagram reelitfeelit tiktok
    tiktokviral youtube youtubeshorts shorts short video videos twitter x reddit linkedin facebook follow followme
    follow-for-more like likes comment share subscribe linkinbio link-in-bio dm collab love photooftheday picoftheday
    bestoftheday amazing beautiful cool nice wow omg lol fun funny new news today daily content post page account
    algorithm boost growth engagement views watch part1 part2 part3 pt1 pt2 duet stitch sound capcut edit edits
    editing aesthetic vibes mood thisorthat asmr satisfying relatable storytime""".split()
SHORT = "ai ml ui ux 3d vr ar go c r".split()
NOT_PLURAL_ENDINGS = "ss us is sis ics ous ness ese ies-".split()
NOT_PLURAL = """
    news series species physics mathematics maths statistics economics politics analytics graphics ethics logistics
    robotics genetics diabetes means lens bias canvas gas always chaos cosmos iris axis basis thesis css js aws ios
    macos hers its""".split()
IE_STEMS = "cook mov brown smooth calor self food newb zomb rook hood vegg beg cad goal prair aud spec".split()
# ------------------------------------------------------------------------------------


def _alias(slug: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, slug), slug)


def _one(word: Column) -> Column:
    keep = (F.length(word) < 4) | ~word.endswith("s") | word.isin(NOT_PLURAL)
    for ending in NOT_PLURAL_ENDINGS:
        keep = keep | word.endswith(ending)
    without = lambda n: F.left(word, F.length(word) - n)
    one = (
        F.when(word.endswith("ies"), F.concat(without(3), F.when(without(3).isin(IE_STEMS), F.lit("ie")).otherwise(F.lit("y"))))
        .when(word.rlike("(sses|ches|shes|xes|zes|oes)$"), without(2))
        .otherwise(without(1))
    )
    return F.when(keep, word).otherwise(one)


def singular(slug: Column) -> Column:
    """The slug with its last word in the singular, by a few cautious rules."""
    word = F.regexp_extract(slug, "([^-]*)$", 1)
    return F.concat(F.left(slug, F.length(slug) - F.length(word)), let(word, _one))


def slug(raw: Column) -> Column:
    """A tag's canonical slug, null where the tag says nothing."""
    t = F.regexp_replace(F.lower(strip(raw)), "^#+", "")
    t = F.regexp_replace(t, r"(?U)[^a-z0-9\s\-+#]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)[\s_]+", "-"), "^-+|-+$", "")
    t = F.regexp_replace(t, "-{2,}", "-")

    def known_or_singular(x):
        usable = (F.length(x) > 2) | ((F.length(x) == 2) & x.isin(SHORT))
        return F.when((x == "") | (F.length(x) > 40), F.lit(None)).when(x.isin(list(ALIASES)), _alias(x)).when(usable, let(singular(x), _alias))

    return let(let(let(t, known_or_singular), _alias), lambda x: F.when(~x.isin(NOISE) & ~x.rlike(r"^\d+$"), x))


def normalize(tags: Column, limit: int = 15) -> Column:
    """Distinct slugs of an array of tags, in order, at most ``limit``."""
    slugs = F.array_compact(F.transform(tags, slug))
    return F.slice(F.array_distinct(slugs), 1, limit)


def _coerce(value: Column, allowed: list[str]) -> Column:
    compact = F.create_map(*[F.lit(x) for a in dict.fromkeys(allowed) for x in (a.replace("-", ""), a)])
    pick = lambda s: F.when(s.isin(allowed), s).otherwise(F.coalesce(F.try_element_at(compact, F.replace(s, F.lit("-"), F.lit(""))), F.lit("other")))
    return let(slug(value), pick)


def category(value: Column) -> Column:
    return _coerce(value, CATEGORIES)


def content_type(value: Column) -> Column:
    return _coerce(value, CONTENT_TYPES)
