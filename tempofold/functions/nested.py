"""Scrubbing inside nested values: strings at any depth of a JSON text or a VARIANT.

Two small Arrow functions cut the string values out and put new ones in their
places; what happens to a string between them is the column rule of ``text``, so
nested and flat values are scrubbed by the same expressions. Everything that is
not a string value - keys, numbers, spacing - keeps its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import CODE_KEYS, scrub_text


def string_spans(doc: str, exempt: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Places of the string values of a JSON text, without those held, at any depth, by an exempt key."""
    import json
    import re

    depth, held, key = 0, None, None
    colon = re.compile(r"\s*:")
    # Plain stretches of a string are one step; a choice per character costs several times as much.
    for m in re.finditer(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]]', doc, re.S):
        piece = m.group()
        if piece in "{[":
            depth += 1
            if held is None and key in exempt:
                held = depth
            key = None
        elif piece in "}]":
            if held == depth:
                held = None
            depth, key = depth - 1, None
        elif colon.match(doc, m.end()):
            key = json.loads(piece)
        else:
            if held is None and key not in exempt:
                yield m.span()
            key = None


def scrub_json(doc: Column, exempt: tuple[str, ...] = CODE_KEYS) -> Column:
    """A JSON text with every string value scrubbed, at any depth; values of ``exempt`` keys stay as they are, whole subtrees too.

    Null stays null. Lists and objects may hold one another; keys are never changed.
    """
    keys = frozenset(exempt)

    @F.pandas_udf("values array<string>, rest array<string>")
    def strings(docs: pd.Series) -> pd.DataFrame:
        import json

        def split(d: str | None):
            if d is None:
                return None, None
            spans = list(string_spans(d, keys))
            ends = [0, *(b for _, b in spans)]
            return [json.loads(d[a:b]) for a, b in spans], [d[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(d)])]

        return pd.DataFrame([split(d) for d in docs], columns=["values", "rest"], dtype=object)

    @F.pandas_udf("string")
    def filled(rest: pd.Series, values: pd.Series) -> pd.Series:
        import json

        def fill(gaps, new) -> str | None:
            if gaps is None:
                return None
            return "".join([*(piece for gap, x in zip(gaps, new) for piece in (gap, json.dumps(x, ensure_ascii=False))), gaps[-1]])

        return pd.Series([fill(g, v) for g, v in zip(rest, values)], dtype=object)

    # The text is read and cut up once; the second function only sees the pieces.
    found = strings(doc)
    return filled(found["rest"], F.transform(found["values"], scrub_text))


def scrub_variant(value: Column, exempt: tuple[str, ...] = CODE_KEYS) -> Column:
    """The same for a VARIANT of any shape."""
    return F.parse_json(scrub_json(F.to_json(value), exempt))
