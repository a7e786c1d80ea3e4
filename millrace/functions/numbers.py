"""Years, popularity, audio features, hashes and vectors over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_year(c: Column) -> Column:
    """The year of mm/dd/yy, 69 to 99 in the last century; else of a date or year that can be read; else empty."""
    two = F.regexp_extract(c, r"^\s*\d{1,2}/\d{1,2}/(\d{2})\s*$", 1)
    y = two.try_cast("int")
    pivoted = F.when(y >= 69, y + 1900).otherwise(y + 2000).cast("string")
    return F.when(two != "", pivoted).otherwise(F.coalesce(F.regexp_extract(c, r"\b(1[4-9]\d\d|20\d\d|2100)\b", 1), F.lit("")))


def year_between(c: Column, low: int = 1400, high: int = 2100) -> Column:
    """A whole year in the range as text, else empty."""
    y = c.try_cast("double").try_cast("int")
    return F.when((y >= low) & (y <= high), y.cast("string")).otherwise("")


def year_of(c: Column) -> Column:
    """The first of the leading four characters and the part before a hyphen that is a year from 1800 to 2100."""
    t = F.trim(c)
    fit = lambda x: F.when(x.try_cast("double").try_cast("int").between(1800, 2100), x.try_cast("double").try_cast("int").cast("string"))
    return F.coalesce(fit(F.substring(t, 1, 4)), fit(F.split_part(t, F.lit("-"), F.lit(1))))


def first_of_year(c: Column) -> Column:
    y = c.try_cast("double").try_cast("int")
    return F.when(y.isNotNull(), F.concat(y.cast("string"), F.lit("-01-01"))).otherwise("")


def whole(c: Column) -> Column:
    """A number as a long; null for what is none or has a fraction."""
    x = c.try_cast("double")
    return F.when(x == F.floor(x), x.try_cast("long"))


def popularity(read: Column, want: Column, editions: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(read) + zero(want) + 10 * zero(editions)


def present01(c: Column) -> Column:
    """A feature from 0 to 1; null for missing, NaN and negative markers."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (x >= 0), x)


def _three(x: Column, low: float, high: float, labels: tuple[str, str, str]) -> Column:
    return F.when(x < low, labels[0]).when(x >= high, labels[2]).when(x.isNotNull(), labels[1])


def audio_phrases(energy, danceability, valence, acousticness, instrumentalness, speechiness, liveness, tempo, mode) -> Column:
    """What the audio features sound like, as phrases joined by commas."""
    e, d, v, a, i, s, l = (present01(x) for x in (energy, danceability, valence, acousticness, instrumentalness, speechiness, liveness))
    t, m = tempo.try_cast("double"), mode.try_cast("double")
    band = F.when(t < 90, "slow").when(t < 130, "mid-tempo").otherwise("fast")
    parts = [
        _three(e, 0.4, 0.7, ("calm and mellow", "moderately energetic", "high-energy and intense")),
        _three(d, 0.4, 0.7, ("not very danceable", "moderately groovy", "very danceable")),
        _three(v, 0.35, 0.65, ("melancholic and somber", "emotionally balanced", "upbeat and positive")),
        F.when(a >= 0.5, "largely acoustic").when(a < 0.2, "electronic/produced"),
        F.when(i >= 0.5, "instrumental (little or no vocals)"),
        F.when(s >= 0.33, "spoken-word / rap-leaning delivery"),
        F.when(l >= 0.5, "live-performance feel"),
        F.when(~F.isnan(t) & (t > 0), F.concat(band, F.lit(" tempo (~"), F.bround(t, 0).cast("long").cast("string"), F.lit(" BPM)"))),
        F.when(m == 1, "major key (brighter)").when(m == 0, "minor key (darker)"),
    ]
    found = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("(audio features unavailable)")


def failure_bin(c: Column) -> Column:
    """Left-closed bins with edges 0, 0.001, 0.2, 0.5, 1.01; null outside."""
    return F.when((c < 0) | (c >= 1.01), None).when(c < 0.001, "[0,0.001)").when(c < 0.2, "[0.001,0.2)").when(c < 0.5, "[0.2,0.5)").when(c.isNotNull(), "[0.5,1.01)")


def image_tokens(width: Column, height: Column, most_pixels: int = 1_003_520) -> Column:
    """Patch pairs of 28 pixels of an image that is scaled down to most_pixels first."""
    shrink = F.least(F.lit(1.0), F.sqrt(F.lit(float(most_pixels)) / (width * height)))
    side = lambda x: F.greatest(F.lit(28.0), F.bround(x * shrink / 28, 0) * 28)
    return (side(width) * side(height) / 784).cast("long")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    d = lambda v: v.cast("array<double>")
    return F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(v.cast("array<double>"), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def euclidean_similarity(a: Column, b: Column) -> Column:
    diff = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return 1 / (1 + F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)))


def pearson_similarity(a: Column, b: Column) -> Column:
    """The correlation moved to [0, 1]; population deviations plus 1e-8."""
    d = lambda v: v.cast("array<double>")
    mean = lambda v: F.aggregate(d(v), F.lit(0.0), lambda s, x: s + x) / F.size(v)
    centred = lambda v, m: F.transform(d(v), lambda x: x - m)
    ca, cb = centred(a, mean(a)), centred(b, mean(b))
    dev = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / F.size(a)) + 1e-8
    cov = F.aggregate(F.zip_with(ca, cb, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return (cov / (dev(ca) * dev(cb)) + 1) / 2
