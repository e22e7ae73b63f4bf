"""Column functions on titles, names, links and questions.

Null texts behave like empty ones unless a docstring says otherwise; results are built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a question's terms leave out.
STOPWORDS = tuple((
    "the a an of and or to in on for with is are be as by at from that this what which how does do did why "
    "when we our their its it also than then these those between across over under more most less least there here into out "
    "about after before during any some all can could would should may might will shall must have has had been being").split())
# Named entities that feeds use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blank(c: Column) -> Column:
    """Whether a text is null, empty or only blanks."""
    return F.trim(filled(c)) == ""


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(filled(c), r"\s+", " "))


def clean_html(c: Column) -> Column:
    """Tags become blanks, white space is squeezed."""
    return squeeze(F.regexp_replace(filled(c), "<[^>]+>", " "))


def unescape(c: Column) -> Column:
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def shorten(c: Column, n: int) -> Column:
    """At most n characters, cut at the last blank before that, without a trailing mark, and with an ellipsis."""
    cut = F.regexp_replace(F.substring(c, 1, n), r"\s+\S*$", "")
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(cut, "[ ,;:.]+$", ""), F.lit("…"))).otherwise(c)


def tidy(c: Column, n: int = 480) -> Column:
    """Abstracts for display: entities and tags resolved, a leading "Abstract" dropped, shortened."""
    return shorten(F.regexp_replace(clean_html(unescape(filled(c))), "^Abstract[:.]? ", ""), n)


def title_key(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", " "))


def title_key_joined(c: Column) -> Column:
    """The variant that deletes marks instead of parting words at them."""
    return F.regexp_replace(F.lower(filled(c)), "[^a-z0-9 ]", "")


def title_key_hyphens(c: Column) -> Column:
    """The variant that keeps hyphens and doesn't squeeze."""
    return F.regexp_replace(F.lower(filled(c)), "[^a-z0-9 -]", " ")


def person_key(c: Column) -> Column:
    """struct(first, last) of a name's tokens, null for fewer than two; initials lose their points."""
    kept = F.regexp_replace(F.replace(F.lower(filled(c)), F.lit("."), F.lit(" ")), r"[^a-z\s-]", "")
    tokens = F.filter(F.split(kept, r"\s+"), lambda t: t != "")
    return F.when(F.size(tokens) >= 2, F.struct(F.get(tokens, F.lit(0)).alias("first"), F.element_at(tokens, -1).alias("last")))


def surnames(c: Column) -> Column:
    """Distinct last tokens, longer than two letters, of a list of authors."""
    people = F.split(F.lower(filled(c)), r"\s*[,;&]\s*|\s+and\s+")
    last = F.transform(people, lambda p: F.get(F.reverse(F.filter(F.split(p, "[^a-z]+"), lambda t: F.length(t) > 2)), F.lit(0)))
    return F.array_distinct(F.filter(last, lambda t: t.isNotNull()))


def question_terms(c: Column) -> Column:
    """Distinct words of a question in order: longer than two letters and not in the stop list."""
    words = F.split(F.regexp_replace(F.lower(filled(c)), "[^a-z0-9 ]", " "), " +")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS)))


def question_key(c: Column) -> Column:
    """The same for questions with the same terms."""
    return F.array_join(F.array_sort(question_terms(c)), " ")


def keyword_hits(terms: Column, text: Column) -> Column:
    """Share of the terms that occur anywhere in the text; 0 without terms."""
    low = F.lower(filled(text))
    found = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    return F.when(F.size(terms) > 0, found / F.size(terms)).otherwise(0.0)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term occurs in the text, as a substring and without case."""
    low = F.lower(filled(text))
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def safe_name(c: Column, n: int = 120) -> Column:
    return F.substring(F.regexp_replace(filled(c), "[^A-Za-z0-9._-]", "_"), 1, n)


def redact(c: Column) -> Column:
    """Values of key, api_key and mailto parameters are masked."""
    return F.regexp_replace(filled(c), r"((?:api_)?key|mailto)=[^&\s]+", "$1=***")


def venue_label(label: Column, source: Column) -> Column:
    """The journal's label, else the source without its prefix."""
    return F.coalesce(F.when(~blank(label), label), F.regexp_replace(filled(source), "^journal:", ""))


def source_name(c: Column) -> Column:
    """A source without its kind; Other if nothing is left."""
    rest = F.trim(F.regexp_replace(filled(c), "^(journal|blog|firm|topic):", ""))
    return F.when(rest == "", F.lit("Other")).otherwise(rest)


def score_band(c: Column) -> Column:
    return F.when(c >= 70, "high").when(c >= 45, "middle").otherwise("low")


def link_title(c: Column) -> Column:
    """A link's text without reading times, save buttons and dates."""
    out = F.regexp_replace(filled(c), r"(?i)\b(save|article|\d+ min(ute)?s?( read)?)\b", " ")
    return squeeze(F.regexp_replace(out, r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december) \d{4}\b", " "))


def slug_title(url: Column) -> Column:
    """A title made of the last part of a path."""
    part = F.regexp_extract(filled(url), r"([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(part, r"^\d+[-_]|\.[a-z]+$", ""), "[-_]+", " ")))


def embedding_text(title: Column, topic: Column, abstract: Column, summary: Column) -> Column:
    """What is embedded of an item: title, topic and abstract (else summary), 1,600 characters at most."""
    some = lambda c: F.when(~blank(c), c)
    return F.substring(F.concat_ws(" \n", some(title), some(topic), F.coalesce(some(abstract), some(summary))), 1, 1600)


def from_inverted_index(index: Column, n: int = 1500) -> Column:
    """The text of a map word -> positions: words by position, then word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.substring(squeeze(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")), 1, n)
