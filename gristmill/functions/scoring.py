"""Scores of adverts: the base score, a person's own, grades against requirements, and preferences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.dates import days_between, period_end
from gristmill.functions.numbers import clamp, round_half_up

# Tariff points of grades, best first.
A_LEVEL_POINTS = {"A*": 56, "A": 48, "B": 40, "C": 32, "D": 24, "E": 16}
HIGHER_POINTS = {"A": 33, "B": 27, "C": 21, "D": 15}
#: How many points below a requirement still count as close.
CLOSE_POINTS = 8
#: A university without a place in any table.
NO_RANK = 999
#: A penalty this heavy is looked for in the text too.
HEAVY_PENALTY = -60


@dataclass(frozen=True)
class Points:
    """Points of the base score.  ``penalties`` lists (expression, points, label)."""

    roles: Mapping[str, int]
    levels: Mapping[int, int]
    no_level: int = 0
    weak_role: int = 0
    role_with_data: Mapping[str, int] = field(default_factory=dict)
    description_factor: float = 1.0
    degree: int = 0
    title_specific: int = 0
    standard_known: int = 0
    fresh_days: int = 7
    fresh: int = 0
    closing_passed: int = 0
    lead_cap: int = 100
    penalties: Sequence[tuple[str, int, str]] = ()


def _lookup(values: Mapping, key: Column, default: Column) -> Column:
    out = default
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def base_score(title: Column, text: Column, kind: Column, posted: Column, closing: Column, is_lead: Column, today: Column, points: Points) -> Column:
    """Struct of role, level, degree, specificity, freshness, penalties, labels and total.

    :param kind: the struct that ``classify`` gives.
    """
    role = _lookup(points.roles, kind["role"], F.lit(0))
    for name, with_data in points.role_with_data.items():
        role = F.when((kind["role"] == name) & kind["data_words"], with_data).otherwise(role)
    role = F.when(kind["role_via"] == "title_weak", points.weak_role).otherwise(role)
    role = F.when(kind["role_via"] == "description", round_half_up(role * points.description_factor)).otherwise(role).cast("long")
    level = _lookup(points.levels, kind["level"], F.lit(points.no_level))
    degree = F.when(kind["is_degree"], points.degree).otherwise(0)
    specificity = F.when(kind["role_via"] == "title", points.title_specific).otherwise(0) + F.when(kind["has_standard"], points.standard_known).otherwise(0)
    freshness = F.when(days_between(posted, today) <= points.fresh_days, points.fresh).otherwise(0)
    all_text = F.concat_ws("\n", title, F.coalesce(text, F.lit("")))
    hits = [(F.rlike(all_text if n <= HEAVY_PENALTY else title, F.lit(p)), n, label) for p, n, label in points.penalties]
    hits.append((closing < today, points.closing_passed, "closing date passed"))
    penalties = F.lit(0)
    for hit, n, _ in hits:
        penalties = penalties + F.when(hit, n).otherwise(0)
    labels = F.array_compact(F.array(*(F.when(hit, label) for hit, _, label in hits)))
    total = clamp(role + level + degree + specificity + freshness + penalties)
    total = F.when(F.coalesce(is_lead, F.lit(False)), F.least(total, F.lit(points.lead_cap))).otherwise(total)
    named = {"role": role, "level": level, "degree": degree, "specificity": specificity, "freshness": freshness, "penalties": penalties, "total": total}
    return F.struct(*(c.cast("long").alias(n) for n, c in named.items()), labels.alias("labels"))


def role_pref(prefs: Column, role: Column, defaults: Mapping[str, str]) -> Column:
    return F.coalesce(F.try_element_at(prefs, role), _lookup(defaults, role, F.lit("maybe")))


def level_pref(prefs: Column, level: Column, defaults: Mapping[str, str]) -> Column:
    """Null for an unknown level, which is never hidden."""
    key = level.cast("string")
    return F.when(level.isNotNull(), F.coalesce(F.try_element_at(prefs, key), _lookup(defaults, key, F.lit("maybe"))))


def excluded_by(role: Column, level: Column) -> Column:
    """role or level, whichever preference is no, the role first; else null."""
    return F.when(role == "no", "role").when(level == "no", "level")


def personal_parts(base: Column, role: Column, full_role: Column, role_is: Column, level_is: Column, no_level: int, weights: Mapping[str, int], within: Column, extras: Sequence[tuple[str, Column]] = ()) -> Column:
    """Labelled points of a person's own score: array of (label, points), zero extras left out.

    :param base: the base score's struct; ``full_role`` the points of a role named in the title, for confidence.
    :param weights: role_high, role_maybe, level_high, level_maybe and near.
    :param within: whether the advert is within the person's distance.
    """
    confidence = F.when(full_role > 0, F.least(F.lit(1.0), base["role"] / full_role)).otherwise(0.0)
    high = lambda c, kind: F.when(c == "high", weights[f"{kind}_high"]).otherwise(weights[f"{kind}_maybe"])
    parts = [
        ("role", round_half_up(high(role_is, "role") * confidence)),
        ("level", F.when(level_is.isNull(), no_level).otherwise(high(level_is, "level"))),
        *((n, F.nullif(base[n], F.lit(0))) for n in ("degree", "specificity", "freshness", "penalties")),
        ("near", F.when(within, weights["near"])),
        *((n, F.nullif(c, F.lit(0))) for n, c in extras),
    ]
    return F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("label"), c.cast("long").alias("points"))) for n, c in parts)))


def personal_score(base: Column, parts: Column, clamped: bool = True) -> Column:
    """The sum of a person's parts; a base score that was capped caps it, and one of 0 stays 0."""
    raw = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + p["points"])
    own = base["role"] + base["level"] + base["degree"] + base["specificity"] + base["freshness"] + base["penalties"]
    score = F.when(base["total"] < clamp(own), F.least(raw, base["total"])).otherwise(raw)
    return F.when((base["total"] <= 0) | (score <= 0), 0).otherwise(clamp(score) if clamped else score).cast("long")


def best_rank(computing: Column, maths: Column, overall: Column) -> Column:
    """Struct of rank and table: the better of two subjects, the first on a tie, else the overall one."""
    first = computing.isNotNull() & (maths.isNull() | (computing <= maths))
    table = F.when(first, "computer science").when(maths.isNotNull(), "maths").otherwise("overall")
    return F.struct(F.coalesce(F.when(first, computing), maths, overall, F.lit(NO_RANK)).alias("rank"), table.alias("table"))


def split_grades(c: Column) -> Column:
    """Grades in a text, as ``A*AB``."""
    return F.regexp_extract_all(F.regexp_replace(F.upper(c), r"\s+", ""), F.lit(r"A\*|[A-E]"), F.lit(0))


def grades_to_points(grades: Column, highers: bool = False) -> Column:
    """Tariff points of grades: the best three A levels, or all Highers; null without a grade."""
    table = HIGHER_POINTS if highers else A_LEVEL_POINTS
    points = F.reverse(F.array_sort(F.transform(grades, lambda g: _lookup(table, g, F.lit(0)))))
    counted = points if highers else F.slice(points, 1, 3)
    return F.when(F.size(grades) > 0, F.aggregate(counted, F.lit(0), lambda acc, x: acc + x))


def at_least(grade: Column, least: Column) -> Column:
    order = F.array(*map(F.lit, A_LEVEL_POINTS))
    return F.array_position(order, grade) <= F.array_position(order, least)


def takes(mine: Column, asked: Column) -> Column:
    """Whether one of a person's A levels satisfies a subject that is asked for.

    Any kind of maths is maths, computer science is computing, IT and ICT, and the natural sciences are sciences.
    """
    want = F.lower(asked)

    def one(h: Column) -> Column:
        own = F.lower(h)
        maths, computing = own.contains("math"), own == "computer science"
        science = own.isin("physics", "chemistry", "biology")
        return (
            F.when(want.isin("maths", "mathematics"), maths)
            .when(want.isin("ict", "it", "computing", "computer science"), computing)
            .when(want.contains("stem"), maths | science | computing)
            .when(want.contains("science"), science | computing)
            .otherwise(own == want)
        )

    return F.exists(mine, one)


def grade_fit(points: Column, least_grade: Column, n_levels: Column, no_grades: Column, predicted: Column, subjects: Column | None = None, grade_subjects: Column | None = None, mine: Column | None = None) -> Column:
    """meets, close, below, subject or null: predicted grades against what an advert asks for.

    :param points: tariff points asked for; ``least_grade`` of each of ``n_levels`` A levels (three if null).
    :param subjects: subjects asked for; ``grade_subjects`` those that the grade is about, one of which will do.
    :param mine: the person's subjects; unknown (null, empty) ones are no hindrance.

    A grade in one subject is met for certain only if all predicted grades reach it, and missed only if none does.
    """
    none = F.array().cast("array<string>")
    own, asked_for, about = (F.coalesce(none if c is None else c, none) for c in (mine, subjects, grade_subjects))
    grades = split_grades(F.coalesce(predicted, F.lit("")))
    count, gap = F.size(grades), points - grades_to_points(grades)
    known = F.size(own) > 0
    lacks_maths = F.exists(asked_for, lambda x: F.lower(x).contains("math")) & ~F.exists(own, lambda x: F.lower(x).contains("math"))
    lacks = known & (lacks_maths | ((F.size(about) > 0) & ~F.exists(about, lambda x: takes(own, x))))
    levels = F.greatest(count, F.size(own))
    reached, need = F.size(F.filter(grades, lambda g: at_least(g, least_grade))), F.least(F.coalesce(n_levels, F.lit(3)), count)
    by_points = F.when(gap <= 0, "meets").when(gap <= CLOSE_POINTS, "close").when(gap.isNotNull(), "below")
    in_one = F.when(reached == count, "meets").when(reached == 0, "below")
    by_grade = F.when(F.size(about) > 0, in_one).when(reached >= need, "meets").when(reached == need - 1, "close").otherwise("below")
    by_levels = F.when((n_levels > levels) & (levels > 0), "below").when(least_grade.isNotNull() & (count > 0), by_grade).when((n_levels <= levels), "meets")
    return F.when(lacks, "subject").when(points.isNotNull(), by_points).when(F.coalesce(no_grades, F.lit(False)), F.when((count > 0) | known, "meets")).otherwise(by_levels)


#: Days that an advert is new.
NEW_DAYS = 3


def own_parts(fit: Column, is_degree: Column, start: Column, pay: Column, employer: Column, weights: Mapping[str, int], prefer_degree: Column, earliest_start: Column, least_pay: Column, favourites: Column, rank: Column | None = None, bands: Sequence[tuple[int, int]] = (), band_weight: Column | None = None) -> list[tuple[str, Column]]:
    """Parts of a person's own score beyond the base: (label, points), null where one doesn't apply.

    :param start: struct of date and precision; all of it must be before ``earliest_start`` to be too early.
    :param weights: points for meets, close, below, subject, degree, early, low_pay, favourite.
    :param rank: of the advert's university, with the bands (most rank, points) it may lie in.
    """
    def worth(name: str) -> Column:
        return F.lit(weights[name])

    grades = F.when(fit == "meets", worth("meets")).when(fit == "close", worth("close")).when(fit == "below", worth("below")).when(fit == "subject", worth("subject"))
    parts = [
        ("grades", grades),
        ("degree", F.when(prefer_degree & is_degree, worth("degree"))),
        ("early", F.when(period_end(start["date"], start["precision"]) < earliest_start, worth("early"))),
        ("low_pay", F.when((pay > 0) & (pay < least_pay), worth("low_pay"))),
        ("favourite", F.when(F.array_contains(favourites, employer), worth("favourite"))),
    ]
    if rank is not None and bands:
        points = F.lit(None).cast("int")
        for most, p in reversed(bands):
            points = F.when(rank <= most, p).otherwise(points)
        weighed = F.floor(points * (F.lit(1.0) if band_weight is None else band_weight) + 0.5).cast("int")
        parts.insert(0, ("university", F.nullif(weighed, F.lit(0))))
    return parts


def derived(rows: DataFrame, today: Column, closing: str, first_seen: str) -> DataFrame:
    """``rows`` with days_to_close and is_new; an advert without a closing date has null days."""
    return rows.withColumns({"days_to_close": F.datediff(F.col(closing), today), "is_new": F.coalesce(F.datediff(today, F.col(first_seen)) <= NEW_DAYS, F.lit(False))})
