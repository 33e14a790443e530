"""DuckDB statement of the token-set similarity, by a plain dynamic programme over characters."""

from __future__ import annotations


def similarity_ctes(pairs: str) -> str:
    """CTEs that end in ``similarities`` (p, t, similarity) of the distinct pairs of ``pairs`` (p, t),
    two normalised texts."""
    row = """list_reduce(list_prepend([0], list_transform(range(1, len(a) + 1), lambda i: [i])),
        lambda done, x: list_append(done, greatest(done[-1], above[x[1] + 1],
          CASE WHEN a[x[1]] = c[1] THEN above[x[1]] + 1 ELSE 0 END)))"""
    return f"""
sim_words AS (
  SELECT DISTINCT p, t, list_filter(list_distinct(string_split_regex(p, '\\s+')), lambda w: w <> '') AS l,
         list_filter(list_distinct(string_split_regex(t, '\\s+')), lambda w: w <> '') AS r
  FROM ({pairs})),
sim_parts AS (
  SELECT *, array_to_string(list_filter(l, lambda w: list_contains(r, w)), ' ') AS shared,
         array_to_string(list_sort(list_filter(l, lambda w: NOT list_contains(r, w))), ' ') AS ol,
         array_to_string(list_sort(list_filter(r, lambda w: NOT list_contains(l, w))), ' ') AS orr
  FROM sim_words),
sim_chars AS (
  SELECT *, list_transform(string_split(ol, ''), lambda x: unicode(x)) AS a,
         list_transform(string_split(orr, ''), lambda x: [unicode(x)]) AS b,
         CASE WHEN shared = '' THEN 0 ELSE length(shared) + 1 END AS joint
  FROM sim_parts),
sim_common AS (
  SELECT *, CASE WHEN ol = '' OR orr = '' THEN 0 ELSE
      list_reduce(list_prepend(list_transform(range(len(a) + 1), lambda i: 0::INTEGER), b),
        lambda above, c: {row})[-1] END AS common
  FROM sim_chars),
similarities AS (
  SELECT p, t, CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0e0
    WHEN shared <> '' AND (ol = '' OR orr = '') THEN 1e0
    ELSE greatest(
      1e0 - (length(ol) + length(orr) - 2 * common)::DOUBLE / (2 * joint + length(ol) + length(orr)),
      CASE WHEN shared = '' THEN 0e0
        ELSE 1e0 - (joint + length(ol) - length(shared))::DOUBLE / (length(shared) + joint + length(ol)) END,
      CASE WHEN shared = '' THEN 0e0
        ELSE 1e0 - (joint + length(orr) - length(shared))::DOUBLE / (length(shared) + joint + length(orr)) END)
    END AS similarity
  FROM sim_common)"""
