"""Unified diffs that insert documentation in front of an element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions import text as T


def insertion_diff(location: Column, lines: Column, line: Column, docstring: Column, context: int = 3) -> Column:
    """The diff that adds docstring before ``line`` (from 1) of the file's lines; '' without a docstring.

    The header counts from the first line shown, also where fewer than ``context`` lines precede.
    """
    start = F.greatest(line - context, F.lit(1))
    shown = F.slice(lines, start, F.greatest(line + context - start, F.lit(0)))
    n_before = F.least(line - start, F.size(shown))
    doc = F.transform(T.lines(T.strip(docstring)), lambda x: F.rtrim(x, F.lit(T.BLANK)))
    head = F.concat(F.lit("diff --git a/"), location, F.lit(" b/"), location, F.lit("\nindex 0000000..0000000 100644\n--- a/"), location, F.lit("\n+++ b/"), location, F.lit("\n"))
    chunk = F.concat(F.lit("@@ -"), start, F.lit(","), F.size(shown), F.lit(" +"), start, F.lit(","), F.size(shown) + F.size(doc), F.lit(" @@\n"))
    mark = lambda xs, m: F.transform(xs, lambda x: F.concat(F.lit(m), x))
    body = F.concat(mark(F.slice(shown, 1, n_before), " "), mark(doc, "+"), mark(F.slice(shown, n_before + 1, F.size(shown)), " "))
    return F.when(F.coalesce(docstring, F.lit("")) == "", "").otherwise(F.concat(head, chunk, T.join_lines(body), F.lit("\n")))
