"""Column functions of the five score axes and of the ranking policies.

Scores are doubles between 0 and 1, totals are rounded to four places. Weights are always an input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendspan.functions import text as tx
from trendspan.functions import times as tm
from trendspan.functions import urls as ur

# The weights of a scorer that is given none, and the axes' constants.
WEIGHTS = {"recency": 0.24, "frequency": 0.10, "authority": 0.14, "velocity": 0.30, "engagement": 0.22}
HALF_LIFE_HOURS = 9.0
TIER_AUTHORITY = {"P0_CURATED": 1.0, "P1_CONTEXT": 0.6, "P2_RAW": 0.3, "COMMUNITY": 0.15}
RECENT_HOURS, BASELINE_HOURS = 6, 24
# Topics that say little on their own, and domains whose releases count as structured.
BROAD_KEYWORDS = ["mcp server", "mcp 서버", "ai coding agent", "ai 코딩 에이전트", "vibe coding", "바이브코딩", "ai 지침 파일"]
RELEASE_DOMAINS = ["github.com", "npmjs.com", "pypi.org", "crates.io", "producthunt.com", "openai.com", "anthropic.com", "microsoft.com", "googleblog.com", "developers.googleblog.com", "vercel.com"]
SUSPICIOUS_DOMAINS = ["finance.yahoo.com", "ca.finance.yahoo.com", "sports.chosun.com", "newstown.co.kr", "eurovision.tv"]
RELEASE_PATTERN = r"(?i)(?:^|[\s/@])(?:v?\d+\.\d+(?:\.\d+)?|canary|alpha|beta|rc|preview|12b|70b|405b|release|changelog)(?:$|[\s.@:-])"
QUALITY_FLOOR = -0.12
RELEVANT = 0.45


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def recency(age_hours: Column) -> Column:
    return tm.half_life(age_hours, HALF_LIFE_HOURS)


def frequency(domains: Column, bonus: Column) -> Column:
    return F.least(F.lit(1.0), (domains + bonus) / 10)


def authority(tier: Column, override: Column) -> Column:
    by_tier = F.lit(0.2)
    for name, value in TIER_AUTHORITY.items():
        by_tier = F.when(tier == name, value).otherwise(by_tier)
    return F.greatest(by_tier, F.coalesce(override, F.lit(0.0)))


def velocity(recent: Column, baseline: Column, domains: Column) -> Column:
    """Items of the last 6 hours against those of the 18 before, damped with one domain only."""
    ratio = (recent + 1) / (baseline / ((BASELINE_HOURS - RECENT_HOURS) / RECENT_HOURS) + 1)
    return F.round(clamp01((ratio - 1) / (ratio + 1)) * F.when(domains <= 1, 0.75).otherwise(1.0), 4)


def engagement(points: Column, comments: Column) -> Column:
    interest = points + 2 * comments
    return F.when(interest > 0, F.least(F.lit(1.0), F.log10(interest + 1) / 4)).otherwise(0.0)


def total(axes: dict[str, Column], weights: dict[str, float] | dict[str, Column] = WEIGHTS) -> Column:
    out = F.lit(0.0)
    for name, axis in axes.items():
        w = weights[name]
        out = out + axis * (w if isinstance(w, Column) else F.lit(float(w)))
    return out


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def policy_delta(kind: Column, version: Column, domains: Column, count: Column, authority: Column, engagement: Column) -> Column:
    """What a keyword's kind and version add or take."""
    significant = (authority >= 0.6) | (domains >= 3) | (engagement > 0)
    release = F.when(significant & (version == "major"), 0.04).when(significant & (version == "minor"), 0.02).otherwise(0.005)
    weak = (kind == "version_only") & (domains < 2) & (count < 3) & (authority < 0.84) & (engagement < 0.45)
    lone = (domains == 1) & (engagement == 0) & (authority <= 0.3) & (count <= 1)
    parts = [
        F.when(kind.isin("incident", "feature_event"), 0.02).otherwise(0.0),
        F.when(kind == "version_release", release).when(version == "major", 0.01).otherwise(0.0),
        F.when(version == "patch", -0.02).when(version == "build", -0.04).otherwise(0.0),
        F.when(weak, -0.04).otherwise(0.0),
        F.when(lone, -0.14).otherwise(0.0),
    ]
    return F.round(_sum(parts), 4)


def stability_delta(is_new: Column, previous_rank: Column, appearances: Column, domains: Column, recency: Column, velocity: Column, engagement: Column, authority: Column) -> Column:
    """What a keyword's history adds or takes."""
    breakout = (engagement >= 0.45) | (authority >= 0.84) | (velocity >= 0.45) | (domains >= 3)
    seen = F.coalesce(appearances, F.lit(0))
    parts = [
        F.when(is_new, F.when(breakout, 0.03).otherwise(-0.03)).when(F.coalesce(previous_rank, F.lit(999)) <= 10, 0.01).otherwise(0.0),
        F.when((seen >= 8) & (seen < 12), F.when(velocity >= 0.35, 0.015).otherwise(0.005)).when(seen >= 12, F.when(velocity < 0.35, -0.08).otherwise(0.005)).otherwise(0.0),
        F.when(~is_new & (recency < 0.25) & (velocity < 0.08) & (engagement < 0.2), -0.02).otherwise(0.0),
    ]
    return F.round(_sum(parts), 4)


def freshness_reasons(recent_source: Column, structured_release: Column, reignited: Column, recency: Column, velocity: Column, engagement: Column) -> Column:
    """Why a keyword counts as fresh, in order; stale without any reason."""
    checks = {
        "recent_source": recent_source,
        "structured_release": structured_release,
        "breakout_velocity": (velocity >= 0.6) & (recency >= 0.45),
        "community_interest": engagement >= 0.65,
        "reignition": reignited,
    }
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("stale_no_evidence"))).otherwise(found)


def freshness_strength(reasons: Column, velocity: Column, engagement: Column, authority: Column) -> Column:
    worth = {"recent_source": F.lit(0.72), "structured_release": F.lit(0.68), "breakout_velocity": velocity, "community_interest": engagement, "reignition": F.lit(0.66)}
    best = F.greatest(authority * 0.5, *(F.when(F.array_contains(reasons, r), w).otherwise(0.0) for r, w in worth.items()))
    return F.when(F.array_contains(reasons, "stale_no_evidence"), 0.0).otherwise(best)


def token_match_ratio(words: Column, haystack: Column) -> Column:
    return F.when((F.size(words) == 0) | (haystack == ""), 0.0).otherwise(F.size(F.filter(words, lambda w: F.contains(haystack, w))) / F.size(words))


def source_quality(keyword: Column, title: Column, snippet: Column, url: Column, domain: Column) -> Column:
    """How well a source fits a keyword: anchors in its title, snippet, URL and domain, less for suspicious domains."""
    surface = tx.source_surface(keyword)
    words = F.filter(tx.tokens(surface), lambda w: (F.length(w) >= 2) & (w != "ai"))
    d = F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")
    hangul = F.coalesce(title, F.lit("")).rlike(tx.HANGUL) | F.coalesce(snippet, F.lit("")).rlike(tx.HANGUL)

    def score(of: Column) -> Column:
        t, s, u, both = of["t"], of["s"], of["u"], F.concat(of["t"], F.lit(" "), of["s"])
        in_title, in_snippet = token_match_ratio(words, t), token_match_ratio(words, s)
        parts = [
            F.when((surface != "") & F.contains(both, surface), 0.62).otherwise(0.0),
            F.when(in_title >= 0.5, in_title * 0.28).otherwise(0.0),
            F.when(in_snippet >= 0.5, in_snippet * 0.18).otherwise(0.0),
            F.when(token_match_ratio(words, u) >= 0.5, 0.16).otherwise(0.0),
            F.when(token_match_ratio(words, d) >= 0.5, 0.12).otherwise(0.0),
            F.when(tx.contains_any(both, ["claude code", "codex"]) & hangul, 0.12).otherwise(0.0),
            F.when(ur.in_domains(d, SUSPICIOUS_DOMAINS), -0.22).otherwise(0.0),
        ]
        return clamp01(F.round(_sum(parts), 4))

    # The surfaces of whole texts are dear, and each is named several times.
    return tx.once(F.struct(tx.source_surface(title).alias("t"), tx.source_surface(F.coalesce(snippet, F.lit(""))).alias("s"), tx.source_surface(url).alias("u")), score)


def generic_delta(is_broad: Column, anchored: Column, stale: Column, authority: Column, engagement: Column) -> Column:
    """Broad topics without an anchor lose; more where nothing is fresh or of interest."""
    weak = stale | ((authority < 0.45) & (engagement < 0.2))
    return F.when(is_broad & ~anchored, F.when(weak, -0.07).otherwise(-0.04)).otherwise(0.0)


def repeat_delta(appearances: Column, velocity: Column, engagement: Column, authority: Column, stale: Column, reignited: Column, is_broad: Column, has_source: Column) -> Column:
    """What repeated exposure adds or takes."""
    breakout = (velocity >= 0.45) | (engagement >= 0.45) | (authority >= 0.84)
    return (
        F.when(appearances < 8, 0.0)
        .when(appearances < 12, F.when(breakout, 0.015).otherwise(0.005))
        .when(stale, -0.12)
        .when(is_broad & (~reignited | ~has_source), -0.11)
        .when(reignited & has_source & breakout, F.when(is_broad, -0.03).otherwise(-0.02))
        .when(breakout & has_source, -0.05)
        .otherwise(-0.1)
    )


def quality_delta(has_source: Column, stale: Column, generic: Column, repeat: Column) -> Column:
    """All quality deltas, floored."""
    summed = F.when(has_source, 0.0).otherwise(-0.04) + F.when(stale, -0.05).otherwise(0.0) + generic + repeat
    return F.round(F.greatest(summed, F.lit(QUALITY_FLOOR)), 4)


def launch_signal(daily_rank: Column) -> Column:
    """Authority and domain bonus of a product's rank of the day."""
    top, good = daily_rank <= 3, daily_rank <= 10
    return F.struct(F.when(top, 0.9).when(good, 0.84).otherwise(0.72).alias("authority"), F.when(top, 2.0).when(good, 1.0).otherwise(0.5).alias("bonus"))


def article_score(impact: Column, novelty: Column, proof: Column, age: Column, penalties: list[Column]) -> Column:
    """A weighted score of 0 to 5 axes with a recency of 36 hours' half-life; penalties are taken once each."""
    fresh = F.greatest(F.lit(0.0), 5 * tm.half_life(age, 36.0) - F.when(age > 24, 0.5).otherwise(0.0))
    score = impact * 0.35 + novelty * 0.25 + proof * 0.25 + fresh * 0.15
    for p in penalties:
        score = score - p
    return F.round(F.greatest(F.lit(0.0), score), 4)
