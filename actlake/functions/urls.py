"""Addresses of source documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import ColumnLike, as_column, found

_ABSOLUTE = r"^(?i:https?)://([^/?#]*)"


def is_valid_source_url(url: ColumnLike, host: str) -> Column:
    """http(s) address whose authority contains ``host``; false for anything else."""
    return F.coalesce(F.regexp_extract(as_column(url), _ABSOLUTE, 1).contains(host), F.lit(False))


def canonical_doc_url(url: ColumnLike, base: str) -> Column:
    """Detail addresses with a numeric id become the consolidated form; others stay."""
    url = as_column(url)
    doc = found(url, rf"{vocab.DETAIL_FORM}/(\d+)")
    rewritten = F.concat(F.lit(f"{base}/{vocab.CONSOLIDATED_FORM}/"), doc)
    return F.when(url.contains(vocab.CONSOLIDATED_FORM), url).otherwise(F.coalesce(rewritten, url))


def candidate_urls(url: ColumnLike, base: str) -> Column:
    """Addresses to try, in order: printable form, consolidated form, the address itself."""
    url = as_column(url)
    doc = found(url, rf"(?:{vocab.DETAIL_FORM}|{vocab.CONSOLIDATED_FORM})/([A-Z0-9]+)")
    forms = F.array(
        F.concat(F.lit(f"{base}/{vocab.PRINT_FORM}/"), doc),
        F.concat(F.lit(f"{base}/{vocab.CONSOLIDATED_FORM}/"), doc),
        url,
    )
    return F.when(doc.isNotNull() & ~url.contains(vocab.PRINT_FORM), forms).otherwise(F.array(url))


def document_id(url: ColumnLike) -> Column:
    """Digits after the form name; a hash of the address where there are none, so reruns agree."""
    doc = found(url, rf"(?:{vocab.DETAIL_FORM}|{vocab.CONSOLIDATED_FORM})/(\d+)")
    return F.coalesce(doc, F.sha2(as_column(url), 256))
