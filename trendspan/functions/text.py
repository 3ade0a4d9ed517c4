"""Column functions over keyword and article text.

All are native expressions. Word bounds are ASCII, as feeds' tools have them, so they are spelt as look-arounds. Unicode
compatibility forms (full-width letters, ligatures) are folded beforehand by ``fold_compatibility`` where a feed has them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and hints of the version and family policies.
MINOR_VARIANT_WORDS = ["small", "mini", "micro", "lite", "base", "core", "pro", "plus", "max", "large", "turbo", "preview", "beta", "alpha"]
FRAMEWORK_SUFFIXES = ["react", "vue", "svelte", "angular", "solid", "next", "nuxt", "python", "javascript", "typescript", "java", "go"]
FAMILY_TRAILING_NOISE = ["release", "releases", "released", "version", "versions", "update", "updates", "updated", "announcement", "announcements", "launch", "launched", "support", "integration", "integrations"] + MINOR_VARIANT_WORDS
INCIDENT_HINTS = ["outage", "incident", "degraded", "downtime", "server down", "down", "latency", "error", "errors", "bug", "bugs", "issue", "issues", "broken", "failure", "failed", "rollback", "revert", "security", "vulnerability", "cve", "장애", "오류", "먹통", "다운", "보안"]
FEATURE_HINTS = ["memory", "import", "teams", "workflow", "workflows", "mode", "modes", "plugin", "plugins", "extension", "extensions", "integration", "integrations", "voice", "audio", "search", "sync", "tool calling", "filesystem", "browser", "desktop", "mobile", "studio", "feature", "features", "support", "memory import", "기능", "지원", "연동", "통합", "음성", "보이스"]
# Fixed value: words that need not occur for a term to match.
STOP_WORDS = ["the", "and", "for", "with", "from", "that", "this", "are", "was", "has", "new", "how", "via", "its", "into", "over", "under", "using", "based", "의", "에", "을", "를", "이", "가", "와", "과"]
# Fixed value: variant words at the end of a keyword.
KEYWORD_VARIANT_WORDS = ["small", "mini", "micro", "lite", "base", "core", "pro", "plus", "max", "large", "turbo", "스몰", "미니", "라이트", "베이스", "프로", "플러스", "맥스", "라지"]
# Words that only head a phrase about something else.
CONTEXT_HEAD_HINTS = ["mode", "modes", "feature", "features", "assistant", "assistants", "workflow", "workflows", "plugin", "plugins", "extension", "extensions", "integration", "integrations", "capability", "capabilities", "voice", "audio", "chat", "agent", "agents", "모드", "기능", "업데이트", "연동", "통합", "보이스", "음성", "도우미"]
CONTEXT_HEAD_SUFFIX = "(?i)(?:mode|feature|assistant|workflow|plugin|extension|integration|capability|voice|audio|chat|agent|모드|기능|업데이트|연동|통합|보이스|음성)$"
# Fixed value: function words, which carry no meaning in a phrase.
FUNCTION_WORDS = ["a", "an", "in", "of", "at", "to", "by", "on", "as", "or"]
# Fixed value: signs that a surface turns into blanks.
SIGNS = "[“”\"'`~!@#$%^&*()+=\\[\\]{}|\\\\:;<>?,]"

# Fixed value: the signs that source quality drops.
SOURCE_SIGNS = "[“”\"'`~!#$%^&*()+=\\[\\]{}|\\\\;<>?,.]"

HANGUL = "[가-힣]"
#: Syllables and both blocks of letters.
ANY_HANGUL = "[\\x{AC00}-\\x{D7AF}\\x{3130}-\\x{318F}\\x{1100}-\\x{11FF}]"
COMPATIBILITY = "[\\x{FF01}-\\x{FFEE}\\x{FB00}-\\x{FB06}\\x{2460}-\\x{24FF}\\x{3300}-\\x{33FF}]"


def fold_compatibility(text: Column) -> Column:
    """NFKC of texts with a compatibility form, by the class of ICU that Spark comes with; Spark has no function of its own for it.

    Not to be used within a function over arrays: Spark takes what is called by name for nondeterministic.
    """
    nfkc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(COMPATIBILITY), nfkc).otherwise(text)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def policy_surface(text: Column) -> Column:
    """Lower case, numbers parted from letters, joining signs and punctuation to blanks."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"([a-z])(\d+(?:\.\d+)?)(?![A-Za-z0-9_])", "$1 $2")
    return collapse(F.regexp_replace(F.regexp_replace(t, r"[_\-·/]+", " "), SIGNS, " "))


def keyword_surface(text: Column) -> Column:
    """As ``policy_surface``, with camelCase split first."""
    return policy_surface(F.regexp_replace(F.trim(text), r"([a-z])([A-Z])", "$1 $2"))


def source_surface(text: Column) -> Column:
    """The surface that source quality compares: parted before one digit, dots dropped too."""
    t = F.regexp_replace(F.lower(text), r"([a-z])(\d)", "$1 $2")
    return collapse(F.regexp_replace(F.regexp_replace(t, r"[_\-·/@:]+", " "), SOURCE_SIGNS, " "))


def broad_surface(text: Column) -> Column:
    """The surface that broad topics and generic keywords are looked up by: letters and numbers stay together."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[_\-·/@:]+", " "), SOURCE_SIGNS, " "))


def compact(text: Column) -> Column:
    return compacted(keyword_surface(text))


def compacted(surface: Column) -> Column:
    """A surface without blanks and dots."""
    return F.regexp_replace(surface, r"[.\s]+", "")


def tokens(surface: Column) -> Column:
    return F.filter(F.split(surface, " "), lambda x: x != "")


def lookup_keys(keyword: Column, aliases: Column) -> Column:
    """The distinct surfaces and compact surfaces, of two letters or more, that a keyword is found by."""
    every = F.concat(F.array(keyword), F.coalesce(aliases, F.array().cast("array<string>")))
    both = F.flatten(F.transform(every, lambda x: F.array(keyword_surface(x), compact(x))))
    return F.array_distinct(F.filter(both, lambda x: F.length(x) >= 2))


def trim_minor_suffix(surface: Column) -> Column:
    """Without trailing variant words such as mini or pro; a word at least stays."""
    return F.regexp_replace(surface, "(?: (?:" + "|".join(KEYWORD_VARIANT_WORDS) + "))+$", "")


def version_tokens(text: Column) -> Column:
    """The numbers in a keyword's surface."""
    return F.array_distinct(F.regexp_extract_all(keyword_surface(text), F.lit(r"(\d+(?:\.\d+){0,2})"), 1))


def ascii_core_tokens(text: Column) -> Column:
    """The words of three ASCII letters or digits and more, with a letter, that are no variant words."""
    plain = F.transform(tokens(keyword_surface(text)), lambda x: F.regexp_replace(x, "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(plain, lambda x: x.rlike("[a-z]") & (F.length(x) >= 3) & ~x.isin(*KEYWORD_VARIANT_WORDS)))


def context_head(token: Column) -> Column:
    """Whether a word only heads a phrase, as mode or plugin does."""
    return token.isin(*CONTEXT_HEAD_HINTS) | token.rlike(CONTEXT_HEAD_SUFFIX)


def anchor_tokens(text: Column, generic: list[str]) -> Column:
    """The words of a keyword that name something: not generic, no function, stop or head word."""
    named = lambda x: (F.length(x) >= 2) & ~x.isin(*generic, *FUNCTION_WORDS, *STOP_WORDS) & ~context_head(x) & x.rlike("[a-z0-9\\x{AC00}-\\x{D7AF}]")
    return F.filter(tokens(keyword_surface(text)), named)


def context_dependent(text: Column, generic: list[str]) -> Column:
    """Whether a keyword says nothing on its own: head words only, or a generic word before one."""
    t = tokens(keyword_surface(text))
    pair = (F.size(t) == 2) & F.get(t, F.lit(0)).isin(*generic) & context_head(F.get(t, F.lit(1)))
    return (F.size(t) > 0) & (F.size(anchor_tokens(text, generic)) == 0) & (F.forall(t, context_head) | F.coalesce(pair, F.lit(False)))


def ascii_variant(text: Column) -> Column:
    """A Hangul-bearing text without its Hangul and the signs left beside it; null where there is none, or hardly anything left."""
    t = F.regexp_replace(text, ANY_HANGUL + "+", " ")
    t = collapse(F.regexp_replace(F.regexp_replace(t, r"[-·]\s", " "), r"\s[-·]", " "))
    return F.when(text.rlike(ANY_HANGUL) & (F.length(t) >= 3), t)


def base36_hash(text: Column) -> Column:
    """The 31-polynomial hash of the characters modulo 2^32, in base 36."""
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % (1 << 32))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def slug(text: Column) -> Column:
    """An ASCII id; texts with Hangul or next to nothing else get a hash."""
    ascii_id = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(text.rlike(HANGUL) | (F.length(ascii_id) < 2), F.concat(F.lit("kw_"), base36_hash(text))).otherwise(ascii_id)


def manual_id(mode: Column, keyword: Column) -> Column:
    return F.concat(F.lit("manual_"), mode, F.lit("_"), base36_hash(F.lower(F.trim(keyword))))


def version_kind(text: Column) -> Column:
    """build, patch, minor, major or none, by the first number of the surface."""
    raw, surface = F.lower(F.trim(text)), policy_surface(text)
    number = F.regexp_extract(surface, r"(?<![A-Za-z0-9_])(\d+(?:\.\d+){0,2})(?![A-Za-z0-9_])", 1)
    parts = F.split(number, r"\.")
    return (
        F.when(surface == "", "none")
        .when(raw.rlike(r"(?<![A-Za-z0-9_])b\d{3,}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])build[\s-]*\d{3,}(?![A-Za-z0-9_])"), "build")
        .when(number == "", "none")
        .when(F.size(parts) >= 3, "patch")
        .when((F.size(parts) == 2) & (F.get(parts, F.lit(1)) != "0"), "minor")
        .otherwise("major")
    )


def is_version_token(token: Column) -> Column:
    return token.rlike(r"^(?:b|build)\d{3,}$|^\d+(?:\.\d+){0,2}$")


def contains_any(text: Column, hints: list[str]) -> Column:
    """Whether the text holds one of the hints, as a substring: one pattern, in one pass over the text."""
    return text.rlike("|".join(re.escape(h) for h in sorted(hints, key=len)))


def keyword_kind(text: Column, version: Column) -> Column:
    """incident, then feature_event, then by version."""
    surface = policy_surface(text)
    core = F.filter(tokens(surface), lambda x: ~is_version_token(x) & ~x.isin(*MINOR_VARIANT_WORDS) & ~x.isin(*FRAMEWORK_SUFFIXES))
    return (
        F.when(surface == "", "named_topic")
        .when(contains_any(surface, INCIDENT_HINTS), "incident")
        .when(contains_any(surface, FEATURE_HINTS), "feature_event")
        .when(version == "none", "named_topic")
        .when(F.size(core) <= 3, "version_only")
        .otherwise("version_release")
    )


def stem_family(text: Column) -> Column:
    """The first two tokens, three for SDKs, APIs and code, once versions, noise and a framework at the end are off."""
    t = tokens(policy_surface(text))
    t = F.when((F.size(t) >= 4) & (F.get(t, F.lit(1)) == "org"), F.slice(t, 3, F.greatest(F.size(t), F.lit(1)))).otherwise(t)
    # From the right: how many tokens stay, two at least.
    noise = lambda x: is_version_token(x) | x.isin(*FAMILY_TRAILING_NOISE)
    kept = F.greatest(F.array_max(F.transform(t, lambda x, i: F.when(~noise(x) | (i < 2), i + 1).otherwise(0))), F.lit(1))
    t = F.slice(t, F.lit(1), kept)
    t = F.when((F.size(t) >= 4) & F.element_at(t, -1).isin(*FRAMEWORK_SUFFIXES), F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t)
    wide = F.array_contains(t, "sdk") | F.array_contains(t, "api") | F.array_contains(t, "code")
    label = F.array_join(F.slice(t, F.lit(1), F.when(wide, 3).otherwise(2)), " ")
    return F.coalesce(F.nullif(label, F.lit("")), policy_surface(text))


def strip_html(text: Column) -> Column:
    """Without tags, and with the common character references decoded."""
    t = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(c))
    return F.trim(t)


EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}\\x{2B00}-\\x{2BFF}\\x{FE0F}\\x{200D}]"


def remove_emojis(text: Column) -> Column:
    """Without emojis; a heading's marks keep one blank behind them."""
    return F.regexp_replace(F.regexp_replace(text, EMOJI, ""), r"(?m)^(#{1,6})[ \t]*(?=\S)(?!#)", "$1 ")


def clean_summary(text: Column, most: int = 440) -> Column:
    """One paragraph without emojis and bullets, cut at ``most`` characters."""
    t = F.regexp_replace(F.regexp_replace(text, EMOJI, ""), r"(?m)^[ \t]*(?:[-*•]|\d+[.)])[ \t]+", "")
    return F.substring(collapse(t), 1, most)


def truncate(text: Column, most: int) -> Column:
    """Cut with an ellipsis that counts; null as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def truncate_at_sentence(text: Column, most: int) -> Column:
    """Cut after the last sentence that ends within ``most`` characters, or with an ellipsis."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= most, text).when(cut != "", cut).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def numbered_lines(text: Column) -> Column:
    """The texts of lines such as ``3. text``, in order."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_extract(x, r"^\s*\d+[.)]\s*(.+)$", 1))), lambda x: x != "")


def words_contained(text: Column, words: Column, least: int = 1) -> Column:
    """How many of the words the text holds."""
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def significant_words(keyword: Column) -> Column:
    """The words that all have to occur in an item: three letters or more and no stop word."""
    return F.filter(tokens(F.lower(keyword)), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def term_matches(text: Column, term: Column) -> Column:
    """A term of up to two letters as a whole word; with at most one significant word the term as it stands; else all of these."""
    words = significant_words(term)
    quoted = F.regexp_replace(F.lower(term), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    # A word's bound: a word character on one side only.
    word = "[a-z0-9_]"
    before = F.when(F.lower(term).rlike("^" + word), f"(?<!{word})").otherwise(f"(?<={word})")
    after = F.when(F.lower(term).rlike(word + "$"), f"(?!{word})").otherwise(f"(?={word})")
    whole = F.regexp_like(text, F.concat(before, quoted, after))
    return F.when(F.length(term) <= 2, whole).when(F.size(words) <= 1, F.contains(text, F.lower(term))).otherwise(F.forall(words, lambda w: F.contains(text, w)))


def title_key(title: Column) -> Column:
    """A title in lower case without common punctuation, of whatever script."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[.,!?;:()\[\]{}\"—–-]", " "))


def headline(text: Column) -> Column:
    """Whether a keyword reads like a headline: quotes, a counted list, or a sentence's end."""
    return text.rlike("[\"“”‘’]|\\d+종|(?:다|요|까)$|[.!?]$")


def repo_slug(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")


def mixed_script_hyphen(text: Column) -> Column:
    return F.exists(F.split(text, r"\s+"), lambda w: w.rlike("[A-Za-z]-[가-힣]|[가-힣]-[A-Za-z]"))


def prefer(localized: Column, plain: Column) -> Column:
    """The localised text unless it is missing or empty."""
    return F.coalesce(F.nullif(localized, F.lit("")), plain)


def first_json(text: Column, kind: str = "array") -> Column:
    """The first array or object in a model's answer, code fences dropped."""
    plain = F.regexp_replace(text, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)(\[.*\])" if kind == "array" else r"(?s)(\{.*\})", 1), F.lit(""))


def bullets(text: Column) -> Column:
    """A JSON list of strings in a text column; anything else is empty."""
    return F.coalesce(F.from_json(text, T.ArrayType(T.StringType())), F.array().cast("array<string>"))


def uri_component(text: Column) -> Column:
    """Percent-encoding that leaves ``!'()*~`` and writes a blank as %20."""
    t = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, c in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        t = F.replace(t, F.lit(code), F.lit(c))
    return t
