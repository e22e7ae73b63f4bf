"""Identity keys and links of papers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, filled, title_key

_ARXIV = r"(\d{4}\.\d{4,5})"


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(filled(c), pattern, 1), F.lit(""))


def paper_uid(doi: Column, arxiv_id: Column, url: Column, title: Column) -> Column:
    """One key for each paper: arXiv id (from its DOI, its field, or the link), else DOI, else a hash of the title.

    Versions of one preprint share a key.
    """
    low = F.lower(filled(doi))
    arxiv = F.coalesce(_found(low, r"10\.48550/arxiv\." + _ARXIV), _found(arxiv_id, "^" + _ARXIV), _found(F.lower(filled(url)), r"(?:arxiv\.org/(?:abs|pdf)/|repec:arx:papers:)" + _ARXIV))
    plain = F.regexp_replace(F.trim(low), r"^https?://(dx\.)?doi\.org/", "")
    return F.when(arxiv.isNotNull(), F.concat(F.lit("arxiv:"), arxiv)).when(~blank(plain), F.concat(F.lit("doi:"), plain)).otherwise(F.concat(F.lit("t:"), F.substring(F.sha1(title_key(title).cast("binary")), 1, 16)))


def pdf_link(uid: Column, url: Column) -> Column:
    """A link to the full text, if it follows from the key or the page's link; else null."""
    arxiv = _found(uid, "^arxiv:(.+)$")
    from_url = _found(url, r"arxiv\.org/abs/([^/?#]+)")
    paper = _found(url, r"nber\.org/papers/(w\d+)")
    return F.coalesce(
        F.when(filled(url).rlike(r"(?i)\.pdf([?#].*)?$"), url), F.concat(F.lit("https://arxiv.org/pdf/"), F.coalesce(arxiv, from_url)),
        F.concat(F.lit("https://www.nber.org/system/files/working_papers/"), paper, F.lit("/"), paper, F.lit(".pdf")))


def free_link(uid: Column, url: Column) -> Column:
    """A link to the full text that follows from the page's link or the key, without case: arXiv before a mirror of it,
    then working papers, then links that are files themselves; null if none does."""
    arxiv = F.coalesce(_found(url, r"(?i)arxiv\.org/abs/([^/?#]+)"), _found(uid, "^arxiv:(.+)$"), _found(url, r"(?i)repec:arx:papers:([\d.]+)"))
    paper = _found(url, r"(?i)nber\.org/papers/w(\d+)")
    return F.coalesce(
        F.concat(F.lit("https://arxiv.org/pdf/"), arxiv), F.concat(F.lit("https://www.nber.org/system/files/working_papers/w"), paper, F.lit("/w"), paper, F.lit(".pdf")),
        F.when(filled(url).rlike(r"(?i)\.pdf(\?|$)"), url))
