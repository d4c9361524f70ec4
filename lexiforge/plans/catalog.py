"""All queries over the reference operators, by name."""

from __future__ import annotations

from . import cells, corpus, marts, more, nested, pages, reviews, tables

FLAGSHIP = "h_class_tfidf"
QUERIES: dict = {**tables.R.queries, **corpus.R.queries, **marts.R.queries, **more.R.queries, **pages.R.queries, **reviews.R.queries, **nested.R.queries, **cells.R.queries}
ORACLE: dict[str, str] = {**tables.R.oracle, **corpus.R.oracle, **marts.R.oracle, **more.R.oracle, **pages.R.oracle, **reviews.R.oracle, **nested.R.oracle, **cells.R.oracle}
