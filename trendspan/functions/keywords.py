"""Column functions that keep, drop, merge or decorate keywords and their sources."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspan.functions import scoring as sc
from trendspan.functions import text as tx
from trendspan.functions import urls as ur

# Fixed value: particles that don't count when a keyword's words are counted.
PARTICLES = ["의", "에", "를", "을", "이", "가", "와", "과", "및", "for", "the", "a", "an", "of", "in", "to"]
# What makes a phrase about AI generic if only generic words follow.
AI_AGENT_PREFIX = r"(?i)^ai[\s-](?:agent[s]?|에이전트)\s*"
AI_PREFIX = r"(?i)^ai[\s-](?:기반|모델|투자|학습용|활용|powered|based|driven|enabled|어시스턴트|오케스트레이션|문서|다중|기사|처리|헬스케어|효율성|지식|document|healthcare|voice|orchestration|article|workflow|productivity|efficiency|automation|management|monitoring|optimization)\s*"
# Fixed value: words of an action at a keyword's end.
TRAILING_ACTION_WORDS = ["도입", "채택", "활용", "공개", "출시", "발표", "확대", "추진", "적용", "업데이트", "통합", "지원", "강화", "개선", "launch", "launched", "release", "released", "update", "updated", "adoption", "adopted", "integration", "integrated"]
#: Rules that a caller gives none of: what is too general, who publishes, what is another topic.
DEFAULT_RULES = {
    "excluded": [],
    "prefixes": [],
    "patterns": [],
    "generic": [],
    "outlets": [],
    "other_topics": [],
}


def drop_reason(keyword: Column, matches: Column, domains: Column, rules: dict[str, Sequence[str]]) -> Column:
    """Why a keyword goes: the first of the rules that holds, or null.

    The rules are tables of the caller: excluded keywords (exact, prefix, pattern), generic words, media outlets and topics
    that are another matter.
    """
    r = {**DEFAULT_RULES, **rules}
    surface, low = tx.policy_surface(keyword), F.lower(keyword)
    split = lambda x: F.split(F.replace(F.lower(x), F.lit("-"), F.lit(" ")), r"\s+")
    words = F.filter(split(keyword), lambda w: (w != "") & ~w.isin(*tx.FUNCTION_WORDS))
    generic = lambda w: w.isin(*r["generic"]) if r["generic"] else F.lit(False)
    counted = F.filter(F.split(keyword, r"\s+"), lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*PARTICLES))

    def generic_after(prefix: str) -> Column:
        rest = F.trim(F.regexp_replace(keyword, prefix, ""))
        return keyword.rlike(prefix) & ((rest == "") | F.forall(F.filter(split(rest), lambda w: F.length(w) >= 2), generic))

    some = lambda xs, f: F.exists(F.array(*map(F.lit, xs)), f) if xs else F.lit(False)
    excluded = some(r["excluded"], lambda x: (surface == x) | (F.replace(surface, F.lit(" "), F.lit("")) == F.replace(x, F.lit(" "), F.lit(""))))
    excluded = excluded | some(r["prefixes"], lambda x: F.startswith(surface, x))
    for p in r["patterns"]:
        excluded = excluded | surface.rlike(p)
    outlet = some(r["outlets"], lambda x: (low == x) | F.startswith(low, F.concat(x, F.lit(" "))) | F.endswith(low, F.concat(F.lit(" "), x)))
    return (
        F.when(matches == 0, "no_match")
        .when(excluded, "excluded")
        .when(generic(surface), "generic")
        .when((F.size(words) >= 2) & F.forall(words, generic), "all_generic")
        .when(generic_after(AI_AGENT_PREFIX), "generic_ai_agent")
        .when(generic_after(AI_PREFIX), "generic_ai_phrase")
        .when(F.size(counted) > 4, "verbose")
        .when(tx.headline(keyword), "headline")
        .when(outlet, "outlet")
        .when(some(r["other_topics"], lambda x: F.contains(low, x)), "other_topic")
        .when(tx.repo_slug(keyword), "repo_slug")
        .when(tx.mixed_script_hyphen(keyword), "transliteration")
    )


def fallback_terms(title: Column) -> Column:
    """Words of a title that stand for keywords where no model gave any: camelCase words, and names with a version in them."""
    word = lambda w: w.rlike(r"^[A-Z][a-z]+[A-Z]") | (w.rlike(r"^[A-Za-z]+-?\d+(?:\.\d+)?$") & (F.length(w) >= 4))
    return F.array_distinct(F.filter(F.split(title, r"\s+"), word))


def core_key(keyword: Column) -> Column:
    """What duplicates of a keyword share: its compact surface without a trailing action word, or else without variant words."""
    surface = tx.keyword_surface(keyword)
    acted = F.regexp_replace(surface, "^(.+) (?:" + "|".join(TRAILING_ACTION_WORDS) + ")$", "$1")
    return tx.compacted(F.when(acted != surface, acted).otherwise(tx.trim_minor_suffix(surface)))


def should_merge(jaccard: Column, same_form: Column, version: Column, ascii_word: Column, cross_script: Column) -> Column:
    """Whether two keywords are one: the same form, or alike items and a shared version, word or script pair."""
    return (
        same_form
        | ((jaccard >= 0.92) & (version | ascii_word | cross_script))
        | ((jaccard >= 0.8) & version & (ascii_word | cross_script))
        | ((jaccard >= 0.75) & ascii_word & (version | cross_script))
    )


def canonical_score(keyword: Column, aliases: Column, matches: Column, tier: Column, generic: Sequence[str] = ()) -> Column:
    """How well a keyword names its cluster; scripts count over its aliases too."""
    surface, every = tx.keyword_surface(keyword), F.concat(F.array(keyword), F.coalesce(aliases, F.array().cast("array<string>")))
    points = [
        F.when(F.exists(every, lambda x: x.rlike("[A-Za-z]")), 40).otherwise(0),
        F.when(~F.exists(every, lambda x: x.rlike(tx.ANY_HANGUL)), 10).otherwise(0),
        F.when(surface.rlike(r"[a-z]\s+\d+(?:\.\d+)?"), 8).otherwise(0),
        F.least(F.size(tx.anchor_tokens(keyword, list(generic))), F.lit(4)) * 5,
        F.least(matches, F.lit(20)).cast("int"),
        F.when(tier == "P0_CURATED", 4).otherwise(0),
        F.when(tx.context_dependent(keyword, list(generic)), -14).otherwise(0),
        F.when(F.element_at(F.split(surface, " "), -1).isin(*tx.KEYWORD_VARIANT_WORDS), -6).otherwise(0),
    ]
    out = points[0]
    for p in points[1:]:
        out = out + p
    return out


def enriched(anchor: Column, head: Column, anchor_surface: Column | None = None, head_surface: Column | None = None) -> Column:
    """Two keywords as one text: the one whose surface holds the other's, else both. Surfaces that are at hand are not made again."""
    a, h = F.trim(anchor), F.trim(head)
    x = tx.keyword_surface(a) if anchor_surface is None else anchor_surface
    y = tx.keyword_surface(h) if head_surface is None else head_surface
    return F.when((a == "") | (F.contains(y, x) & ~F.contains(x, y)), h).when((h == "") | F.contains(x, y), a).otherwise(tx.collapse(F.concat(a, F.lit(" "), h)))


def source_priority(quality: Column, korean_title: Column, korean_snippet: Column, naver: Column, origin: Column, fresh: Column) -> Column:
    return quality + F.when(korean_title, 1.2).when(korean_snippet, 0.6).otherwise(0.0) + F.when(naver, 0.2).otherwise(0.0) + F.when(origin, 2.0).otherwise(0.0) + F.when(fresh, 0.3).otherwise(0.0)


def legacy_type(stored: Column, domain: Column, url: Column) -> Column:
    """Stored types of older rows in today's three."""
    return F.when(stored.isin("news", "social", "data"), stored).when(stored == "video", "data").when(stored.isin("community", "sns"), "social").otherwise(ur.source_category(stored, domain, url))


def displayed(rank: Column, manual: Column, sources: Column, summary: Column, release: Column, velocity: Column, engagement: Column) -> Column:
    """Ranks up to ten are shown; later ones need a reason."""
    return (rank <= 10) | manual | (sources > 0) | (F.length(F.trim(F.coalesce(summary, F.lit("")))) > 0) | release | (velocity >= 0.6) | (engagement >= 0.65)


def fixed_bonus(total: Column, axes: dict[str, Column], weights: dict[str, float] = sc.WEIGHTS) -> Column:
    """What a total has beyond its weighted axes."""
    return F.round(total - sc.total(axes, weights), 4)


def applied_delta(total: Column, delta: Column) -> Column:
    """A total with a delta; none, or one that is no number, changes nothing."""
    usable = delta.isNotNull() & ~F.isnan(delta) & (delta != 0)
    return F.when(usable, F.round(total + delta, 4)).otherwise(total)


def viewer_hash(secret: str, viewer: Column) -> Column:
    """HMAC-SHA256 of a viewer, by the definition of HMAC on SHA-256; a secret longer than a block of 64 bytes is hashed first."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(viewer, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity of two normal titles. A null or empty one is like none."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same of two columns; Spark has no function for it."""
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def valid_image(url: Column) -> Column:
    """Whether a URL may be an article's picture."""
    return url.rlike(r"^https?://") & ~url.rlike(r"(?i)(?:sprite|pixel|avatar|logo|icon|\.svg(?:$|\?)|1x1)")


def first_of_srcset(srcset: Column) -> Column:
    return F.substring_index(F.trim(F.substring_index(srcset, ",", 1)), " ", 1)


def focus_score(body: Column, focus: Sequence[str], no_focus: Sequence[str]) -> Column:
    """Two points for each word of focus in a text, two less for each of the others."""
    many = lambda ws: tx.words_contained(body, F.array(*map(F.lit, ws))) if ws else F.lit(0)
    return 2 * many(focus) - 2 * many(no_focus)


def exact_query(keyword: Column) -> Column:
    """A search for the keyword as a phrase, unless it is one word or quoted already."""
    k = F.trim(keyword)
    quoted = F.startswith(k, F.lit('"')) & F.endswith(k, F.lit('"'))
    return F.when(~quoted & F.contains(k, F.lit(" ")), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)


# What each kind of search asks for besides the keyword.
NEWS_WORDS = "(news OR blog OR analysis OR article OR interview)"
SOCIAL_SITES = "(site:threads.net OR site:reddit.com OR site:dev.to OR site:x.com OR site:twitter.com OR site:facebook.com OR site:clien.net)"
DATA_SITES = "(site:youtube.com OR site:youtu.be OR site:docs.google.com OR site:drive.google.com OR site:arxiv.org OR site:openreview.net OR filetype:pdf OR dataset OR research paper OR benchmark)"


def search_queries(keyword: Column, terms: Column) -> Column:
    """The searches for a keyword: news, social, data and broad. ``terms`` tell it from its namesakes; searches for data go without them."""
    exact = exact_query(keyword)
    told = F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, F.concat(exact, F.lit(" "), F.array_join(terms, " "))).otherwise(exact)
    with_words = lambda q, words: F.concat(q, F.lit(" " + words))
    return F.struct(with_words(told, NEWS_WORDS).alias("news"), with_words(told, SOCIAL_SITES).alias("social"), with_words(exact, DATA_SITES).alias("data"), told.alias("broad"))


def range_start(now: Column, time_range: Column) -> Column:
    """Where a search's range starts: a day, a week, or thirty days before now."""
    days = F.when(time_range == "day", 1).when(time_range == "week", 7).otherwise(30)
    return now - F.make_dt_interval(days=days)


# How insights are put, in the order of their fields.
INSIGHTS = {
    "why_it_matters": "이 소식이 중요한 이유는 {value}",
    "key_evidence": "구체적 근거로 {value}",
    "who_should_care": "특히 {value}에게 직접적인 도움이 됩니다",
    "next_action": "이후에는 {value}",
    "comparison": "경쟁 대비 차별점은 {value}",
}


def insight_lines(insights: dict[str, Column], seed: Column, most: int = 3) -> Column:
    """Up to three of an article's insights as sentences, chosen and ordered by a hash of its seed and the field, between line feeds; empty without any."""
    rows = []
    for field, value in insights.items():
        before, after = INSIGHTS.get(field, "{value}").split("{value}")
        text = F.trim(F.concat(F.lit(before), value, F.lit(after)))
        ended = F.when(F.endswith(text, F.lit("다.")) | F.endswith(text, F.lit("다")), text).otherwise(F.concat(F.regexp_replace(text, r"\.+$", ""), F.lit(".")))
        rows.append(F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.md5(F.concat(seed, F.lit("-" + field))).alias("place"), ended.alias("text"))))
    chosen = F.slice(F.array_sort(F.array_compact(F.array(*rows))), 1, most)
    return F.when(F.size(chosen) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(chosen, lambda r: r["text"]), "\n"), F.lit("\n"))).otherwise("")
