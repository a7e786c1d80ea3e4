"""Text functions over columns: cleaning, keys, lists in strings, prompts, rule checks. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value.
BLANK = ("", "nan", "None")
JUNK = (*BLANK, "[]", "no")
# What follows an author's name in parentheses.
ROLES = ("goodreads author", "illustrator", "translator", "editor", "foreword", "introduction", "contributor", "narrator", "photographer", "adapter", "afterword", "preface")
# Rule patterns for synthetic descriptions.
RULES = {
    "release_info": r"(?i)\b(released|release date|published in|publication|first aired)\b",
    "sales_awards": r"(?i)\b(bestsell\w*|award[- ]winning|chart[- ]topping|prize[- ]winning|no\.? ?1\b)\b",
    "reader_address": r"(?i)\b(you (?:will|'ll|are|can|may)|your \w+|readers will)\b",
    "promotion": r"(?i)\b(must[- ]read|unputdownable|critically acclaimed|beloved classic|page[- ]turner)\b",
    "review_quote": r"[\"“][^\"”]{25,}[\"”]",
}
NARRATIVE = r"(?i)\b(protagonists?|follows? (?:a|an|the)|story of|journey of|(?:struggles?|grapples?|wrestles?) with|discovers?|must (?:find|save|escape|confront))\b"
STOPWORDS = (
    "a an the and or but of in on at to for with from by as is are was were be been it its this that these those his her their he she they who which "
    "into through while when where what s t"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once: as a lambda's variable it is not copied to every place of its use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(c: Column) -> Column:
    """Null, or nothing but a text that stands for it."""
    return c.isNull() | F.trim(c).isin(*BLANK)


def clean(c: Column, junk: tuple[str, ...] = JUNK) -> Column:
    """The trimmed text; null for junk."""
    t = F.trim(c)
    return F.when(t.isin(*junk), None).otherwise(t)


def priority(*columns: Column) -> Column:
    """The first that is not blank, else an empty text."""
    return F.coalesce(*[F.when(~blank(c), c) for c in columns], F.lit(""))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("nan"))


def title_key(c: Column) -> Column:
    """Lower case, without parentheses, up to the first colon, letters and digits only; a null is the word nan."""
    up_to = F.split_part(F.regexp_replace(F.lower(_text(c)), r"\([^)]*\)", " "), F.lit(":"), F.lit(1))
    return F.trim(F.regexp_replace(F.regexp_replace(up_to, "[^a-z0-9 ]", " "), r"\s+", " "))


def author_key(c: Column) -> Column:
    """Distinct words of two letters or more before any parenthesis, sorted."""
    words = F.split(F.split_part(F.lower(_text(c)), F.lit("("), F.lit(1)), "[^a-z]+")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))), " ")


def item_key(title: Column, author: Column) -> Column:
    return F.concat_ws("|", title_key(title), author_key(author))


def strip_roles(c: Column) -> Column:
    bare = F.regexp_replace(c, r"(?i)\s*\((" + "|".join(ROLES) + r")[^)]*\)", "")
    spaced = F.regexp_replace(bare, r"\s*,\s*", ", ")
    return F.coalesce(F.regexp_replace(F.regexp_replace(spaced, r"^[ ,]+|[ ,]+$", ""), r"\s+", " "), F.lit(""))


def tidy_punctuation(c: Column) -> Column:
    moved = F.regexp_replace(F.regexp_replace(c, r"([.!?])\s*,\s*", "$1 "), r"\s+,", ",")
    return F.coalesce(F.trim(F.regexp_replace(moved, r"[ \t]+", " ")), F.lit(""))


def isbn(c: Column) -> Column:
    """The ISBN in upper case; empty if it is no 10 or 13 characters of one, or a placeholder of nines."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike(r"^(\d{9}[\dX]|\d{13})$") & ~t.isin("9999999999", "9999999999999"), t).otherwise("")


def cover_url(isbn_col: Column) -> Column:
    return F.when(isbn_col != "", F.format_string("https://covers.openlibrary.org/b/isbn/%s-L.jpg", isbn_col)).otherwise("")


def split_list(c: Column, sep: str = "|") -> Column:
    """Trimmed parts that are not empty."""
    return F.filter(F.transform(F.split(c, "\\" + sep if sep in "|.+*?" else sep), lambda x: F.trim(x)), lambda x: x != "")


def json_list(c: Column, sep: str = "|") -> Column:
    """The parts as a JSON list with a blank after each comma; [] for none."""
    quoted = F.transform(split_list(F.coalesce(c, F.lit("")), sep), lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def from_json_list(c: Column, limit: int | None = None) -> Column:
    """Texts of a JSON list joined by commas; what is no list is cleaned instead; null if there are none."""
    items = F.from_json(c, "array<string>")
    some = F.slice(items, 1, limit) if limit else items
    looks = F.trim(c).startswith("[")
    return F.when(looks & items.isNotNull(), F.when(F.size(items) > 0, F.array_join(some, ", "))).otherwise(clean(c))


def first_of_json_list(c: Column) -> Column:
    return F.coalesce(F.get(F.from_json(c, "array<string>"), F.lit(0)), F.lit(""))


def strip_year(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\(\d{4}\)\s*$", "")


def main_category(c: Column) -> Column:
    return F.trim(F.split_part(c, F.lit(","), F.lit(1)))


def padded_id(c: Column, width: int = 7) -> Column:
    """Zeros in front up to the width; a longer id stays whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def first_parts(c: Column, parts: int = 3, exact: bool = False) -> Column:
    """The first line outside brackets with at least (or exactly) so many parts, the first of them not empty; null if none."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("["))
    cut = F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), lambda p: F.trim(p)))
    enough = (lambda p: F.size(p) == parts) if exact else (lambda p: F.size(p) >= parts)
    good = F.filter(cut, lambda p: enough(p) & F.forall(F.slice(p, 1, parts), lambda x: x != ""))
    return F.when(F.size(good) > 0, F.array_join(F.slice(F.get(good, F.lit(0)), 1, parts), "|"))


def bad_cached_query(c: Column) -> Column:
    """Blank, not three parts, numbered, or labelled with a persona."""
    persona = "시인:|공간:|철학자:|Poet:|Space:|Philosopher:"
    return c.isNull() | c.isin("", "nan") | (F.size(F.split(c, r"\|")) != 3) | c.rlike(r"^\d+\.") | c.rlike(persona)


def why_invalid(c: Column, parts: int = 3) -> Column:
    """Why a generated line is refused, by its first line outside brackets that gives a reason."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    counted = F.transform(F.filter(lines, lambda x: ~x.startswith("[")), lambda x: F.transform(F.split(x, r"\|"), lambda p: F.trim(p)))
    reason = F.transform(
        counted,
        lambda p: F.when(F.size(p) == 1, "no separator").when(F.size(p) != parts, F.concat(F.lit("parts: "), F.size(p).cast("string"))).when(F.exists(p, lambda x: x == ""), "empty part"),
    )
    first = F.get(F.filter(reason, lambda r: r.isNotNull()), F.lit(0))
    return F.when(F.size(lines) == 0, "empty output").when(F.size(counted) == 0, "labels only").otherwise(F.coalesce(first, F.lit("unknown")))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9']+)"), 1)


def content_words(c: Column) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    return F.filter(F.array_except(words(c), F.array(*[F.lit(w) for w in STOPWORDS])), lambda w: F.length(w) > 2)


def shingles(c: Column, k: int = 5) -> Column:
    """Distinct runs of k words; the whole text if it has fewer; none if it has no words."""

    def runs(w: Column) -> Column:
        n = F.greatest(F.size(w) - (k - 1), F.lit(0))
        out = F.slice(w, 1, n)
        for j in range(1, k):
            out = F.zip_with(out, F.slice(w, j + 1, n), lambda a, b: F.concat_ws(" ", a, b))
        short = F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(w, " ")))
        return F.when(F.size(w) < k, short).otherwise(F.array_distinct(out))

    return let(words(c), runs)


def strip_titles(c: Column, title: Column) -> Column:
    """Without quoted spans of up to 80 characters and without the title, whatever its case."""
    bare = F.regexp_replace(c, "[\"“][^\"”]{1,80}[\"”]", " ")
    t = F.trim(F.coalesce(title, F.lit("")))
    literal = F.concat(F.lit(r"(?i)\Q"), F.replace(t, F.lit("\\E"), F.lit("")), F.lit(r"\E"))
    return F.when((t == "") | (F.lower(t) == "nan"), bare).otherwise(F.regexp_replace(bare, literal, F.lit(" ")))


def sentences(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[.!?](?:\s|$)"))


def overlap(a: Column, b: Column) -> Column:
    """Share of the words of a that b has; null where a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def title_kept(title: Column, text: Column) -> Column:
    """Whether a word of four letters or more of the title is in the text."""
    return F.arrays_overlap(F.filter(words(title), lambda w: F.length(w) >= 4), words(text))


def non_ascii_share(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[\x00-\x7F]", "")) / F.greatest(F.length(c), F.lit(1))


def looks_like_keywords(c: Column) -> Column:
    return (F.regexp_count(c, F.lit(",")) >= 2) & ~F.contains(c, F.lit("."))


def plot_and_keywords(c: Column) -> Column:
    """struct(plot, keywords) of an overview whose last part may be a list of keywords."""
    parts = split_list(c)
    last = F.element_at(parts, -1)
    listed = (F.size(parts) > 1) & looks_like_keywords(last)
    plot = F.array_join(F.when(listed, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), " ")
    return F.struct(plot.alias("plot"), F.when(listed, last).otherwise("").alias("keywords"))


def labelled(**fields: Column) -> Column:
    """Lines `Label: value`, without those that have no value."""
    lines = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def prompt(task: str, meta: Column, **blocks: Column) -> Column:
    """A prompt of our own wording: the task, the item's lines, and a headed block for each text that is not empty."""
    parts = [F.lit(f"[Task]\n{task}"), F.concat(F.lit("[Item]\n"), meta)]
    parts += [F.when(~blank(v), F.concat(F.lit(f"[{k}]\n"), v)) for k, v in blocks.items()]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n\n")


def provenance(**signals: Column) -> Column:
    """Names of the signals that hold, joined by +; meta_only if none does."""
    named = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in signals.items()]), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, F.array_join(named, "+")).otherwise("meta_only")


def grade(c: Column) -> Column:
    """The first o, a or x that stands alone; null if none."""
    found = F.regexp_extract(F.lower(c), r"\b([oax])\b", 1)
    return F.when(found != "", found)


def grade_value(g: Column) -> Column:
    return F.when(g == "o", 2.0).when(g == "a", 1.0).when(g == "x", 0.0)


def strip_links(c: Column) -> Column:
    """Without link elements and their text, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)<a\b[^>]*>.*?</a>", ""), r"\s+", " "))


def larger_artwork(c: Column) -> Column:
    return F.replace(c, F.lit("100x100bb"), F.lit("600x600bb"))


def host(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))


def routed(c: Column) -> Column:
    """struct(domain, query) of a line that may begin with `movie:`, `music:` or `book:`."""
    pattern = r"(?i)^\s*(movie|music|book):\s*(.*)$"
    domain = F.lower(F.regexp_extract(c, pattern, 1))
    return F.struct(F.when(domain != "", domain).alias("domain"), F.when(domain != "", F.regexp_extract(c, pattern, 2)).otherwise(F.trim(c)).alias("query"))


def cut_middle(c: Column, most: int, head: float = 0.6) -> Column:
    """At most so many words: the first 60 and the last 40 per cent, an ellipsis between."""
    w = F.split(F.trim(c), r"\s+")
    first = int(most * head)
    return F.when(F.size(w) <= most, c).otherwise(F.concat_ws(" ", F.array_join(F.slice(w, 1, first), " "), F.lit("..."), F.array_join(F.slice(w, F.size(w) - (most - first) + 1, most - first), " ")))


def shown(extra: Column) -> Column:
    """Values of a map that are not empty, joined for display in the order of their keys."""
    pairs = F.array_sort(F.map_entries(F.map_filter(extra, lambda k, v: v.isNotNull() & (v != ""))))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


def keep_label_lines(c: Column, drop: Column, labels: tuple[str, ...] = ("Title",)) -> Column:
    """Without the lines of these labels where `drop` holds (dropout of titles in training texts)."""
    out = F.split(c, "\n")
    kept = F.filter(out, lambda x: ~F.array_contains(F.array(*[F.lit(v) for v in labels]), F.split_part(x, F.lit(":"), F.lit(1))))
    return F.when(drop, F.array_join(kept, "\n")).otherwise(c)


def content_text(desc_most: int = 600, **fields: Column) -> Column:
    """Labelled lines of an item, the description cut to so many characters."""
    cut = {k: F.substring(v, 1, desc_most) if k == "Description" else v for k, v in fields.items()}
    return labelled(**{k: clean(v) for k, v in cut.items()})


# Promotion that book descriptions begin with.
BADGE = (
    r"(?i)^\s*(an?\s+)?(instant\s+)?(#\d+\s+)?((new york times|usa today|wall street journal|amazon charts|indie|national|international|los angeles times)"
    r"\s*(,\s*|\s+and\s+|\s*/\s*)?)+best.?sell(er|ing)\b[^.!\n]*[.!]?\s*(•\s*)?"
)
COPIES_SOLD = r"(?i)^\s*(over\s+)?[\d,\.]+\+?\s*(million|thousand)?\s*copies\s+sold!?\s*"
CROSS_PROMO = r"(?i)^\s*don'?t miss\b.{0,200}?\bavailable\s+(to\s+(pre-?)?order\s+)?now\.{0,3}\s*"
BLURB = "^\\s*[\"“]([^\"“”]{5,400})[\"”]\\s*[-–—]{1,2}\\s*([A-Z][^\"“]{0,200}?)(?=[\"“]|\\z|(?<=[.)])\\s+[A-Z][a-z]+\\s+[a-z]+\\s+[a-z]+)"


def clean_description(c: Column) -> Column:
    """Without badges, sales, cross-promotion and leading review quotes, peeled off until none is left, however many there are."""
    peeled = "|".join(f"(?:{p})" for p in (_anywhere(x) for x in (BADGE, COPIES_SOLD, CROSS_PROMO, BLURB)))
    return F.trim(F.regexp_replace(F.trim(c), f"^(?:{peeled})++", ""))


def _anywhere(pattern: str) -> str:
    """A pattern of a beginning, without its anchor, and with its flags for itself alone."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return flags + pattern.removeprefix(flags).removeprefix("^")


def strip_wrapping(c: Column) -> Column:
    """Without one pair of quotes around the whole text, if they surely are a pair: the only two, or closing after a sentence."""
    s = F.trim(c)
    shape = "^[\"“](.*)[\"”]([.!?]*)$"
    inner, tail = F.trim(F.regexp_extract(s, "(?s)" + shape, 1)), F.regexp_extract(s, "(?s)" + shape, 2)
    ended = F.regexp_extract(s, "(?s)" + shape, 1).rlike("[.!?]$")
    two = F.regexp_count(s, F.lit("[\"“”]")) == 2
    closed = F.when(inner.rlike("[.!?]$"), inner).when(tail != "", F.concat(inner, tail)).otherwise(F.concat(inner, F.lit(".")))
    return F.when(s.rlike("(?s)" + shape) & (inner != "") & (two | ended), closed).otherwise(c)


def genre_list(c: Column, limit: int = 5) -> Column:
    """The first entries of a list printed with quotes and brackets; a text of another form stays as it is."""
    t = F.trim(c)
    items = F.regexp_extract_all(t, F.lit(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""), 0)
    bare = F.transform(items, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    return F.when(blank(c), "").when(t.rlike(r"^\[.*\]$"), F.array_join(F.slice(bare, 1, limit), ", ")).otherwise(t)
