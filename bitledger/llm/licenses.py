"""License scan: exact set-similarity join of text blocks with license templates.

The blocks of a text are its runs of words, for each template up to the template's words divided
by the threshold, wherever lines end. Tokens of the templates are ordered by their frequency in
the whole corpus, rarest first. A block that holds at least ``threshold`` of a template's tokens
holds one of its rarest (the prefix), so only words near one are looked at; with that one as its
rarest, the tokens after it in the order and those around it must suffice (position), and the
text must be long enough (length). What passes is verified exactly by a sliding block. The
templates are a parameter and travel to the tasks; documents are not moved.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.llm.text import alnum_words, table, utf8

THRESHOLD = 0.8

PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Public license notices, as (label, text).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    ("all-rights-reserved", "All rights reserved. No part of this work may be reproduced without permission."),
]


def template_frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """Occurrences in all documents of the templates' tokens; a dict no larger than those."""
    wanted = {w for _, text in templates for w in alnum_words(text.encode())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                found.update(filter(wanted.__contains__, alnum_words(text or b"")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["w", "n"]
        )

    counted = docs.select("text").mapInArrow(count, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return {w: 0 for w in wanted} | {bytes(w): n for w, n in counted.collect()}


class TemplateJoin:
    """The templates with their prefixes; finds the blocks of a text that hold enough of them."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        order = {w: k for k, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.order = order
        self.labels: list[str] = []
        self.ranks: list[dict[int, int]] = []
        self.needed: list[int] = []
        self.width: list[int] = []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        # In thousandths, without the rounding of a float product.
        share = int(round(threshold * 1000))
        for label, text in templates:
            words = alnum_words(text.encode())
            tokens = sorted({order[w] for w in words})
            if not tokens:
                continue
            needed = max(1, -(-share * len(tokens) // 1000))
            t = len(self.ranks)
            self.labels.append(label)
            self.ranks.append({token: k for k, token in enumerate(tokens)})
            self.needed.append(needed)
            self.width.append(len(words) * 1000 // share if share else len(words))
            for position, token in enumerate(tokens[: len(tokens) - needed + 1]):
                self.prefix.setdefault(token, []).append((t, position))
        self.probe = {w for w, k in order.items() if k in self.prefix}

    def match(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, containment) of the blocks that hold enough of a
        template; blocks of one template that overlap are one, with its best containment."""
        if self.probe.isdisjoint(words):
            return []
        # Other words are in no template.
        held = [(k, self.order[w]) for k, w in enumerate(words) if w in self.order]
        anchors: dict[int, list[tuple[int, int]]] = {}
        for i, (_, token) in enumerate(held):
            for t, position in self.prefix.get(token, ()):
                if len(words) >= self.needed[t]:
                    anchors.setdefault(t, []).append((i, position))
        out = []
        for t in sorted(anchors):
            out += [(t, *found) for found in self._blocks(t, anchors[t], held)]
        return out

    def _blocks(self, t: int, anchors: list[tuple[int, int]], held: list[tuple[int, int]]) -> Iterator[tuple[int, int, float]]:
        ranks, needed, width = self.ranks[t], self.needed[t], self.width[t]
        near: set[int] = set()
        for i, position in anchors:
            low = high = i
            while low and held[low - 1][0] > held[i][0] - width:
                low -= 1
            while high + 1 < len(held) and held[high + 1][0] < held[i][0] + width:
                high += 1
            # The block's rarest token bounds its overlap by what follows in the order.
            after = {token for _, token in held[low : high + 1] if ranks.get(token, -1) >= position}
            if min(len(ranks) - position, len(after)) >= needed:
                near.update(range(low, high + 1))
        mine = [held[i] for i in sorted(near) if held[i][1] in ranks]
        counts: dict[int, int] = {}
        start, open_block = 0, None
        # Per last word the longest block that fits the width.
        for at, token in mine:
            counts[token] = counts.get(token, 0) + 1
            while mine[start][0] <= at - width:
                first = mine[start][1]
                counts[first] -= 1
                if not counts[first]:
                    del counts[first]
                start += 1
            if len(counts) >= needed:
                block = (mine[start][0], at, len(counts) / len(ranks))
                if open_block and block[0] <= open_block[1]:
                    open_block = (min(open_block[0], block[0]), at, max(open_block[2], block[2]))
                else:
                    if open_block:
                        yield open_block
                    open_block = block
        if open_block:
            yield open_block


def phrase_places(words: list[bytes], phrases: list[bytes]) -> list[list[int]]:
    """Start words of each phrase (its words joined by one space)."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase in phrases:
        needle, places, at = b" " + phrase + b" ", [], 0
        before = word = 0
        while (at := joined.find(needle, at)) >= 0:
            word += joined.count(b" ", before, at)
            before = at
            places.append(word)
            at += 1
        out.append(places)
    return out


def license_scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    phrases: list[tuple[str, str]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    matches, labels, score``.

    ``base_labels`` comes from the phrases (``n_base`` places, the first and last start word,
    null without any). ``matches`` lists the runs of words that hold at least ``threshold`` of a
    template's distinct tokens within the template's words divided by ``threshold``, as
    ``(first_word, last_word, label, containment)``; runs of one template that overlap are one.
    ``labels`` joins both kinds, distinct and sorted; ``score`` is 1 where a
    phrase stands and else the best containment, 0 without matches. Null, empty and wordless
    texts have no words and no labels. Rows are kept as they are; an empty table gives an
    empty result; only ``doc_id`` and ``text`` are read.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    frequency = template_frequencies(docs, templates)
    needles = [phrase.encode() for phrase, _ in phrases]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = TemplateJoin(templates, frequency, threshold)
        for batch in batches:
            rows: list[tuple] = []
            for text in utf8(batch.column(1)):
                text = text or b""
                words = alnum_words(text)
                places = phrase_places(words, needles)
                base = [p for found in places for p in found]
                names = {phrases[k][1] for k, found in enumerate(places) if found}
                matches = [(first, last, join.labels[t], share) for t, first, last, share in join.match(words)]
                rows.append(
                    (
                        len(words),
                        len(base),
                        min(base, default=None),
                        max(base, default=None),
                        sorted(names),
                        matches,
                        sorted(names | {m[2] for m in matches}),
                        1.0 if base else max((m[3] for m in matches), default=0.0),
                    )
                )
            cols = list(zip(*rows)) if rows else [()] * 8
            match_type = pa.list_(
                pa.struct(
                    [("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]
                )
            )
            listed = [
                [dict(zip(("first_word", "last_word", "label", "containment"), m)) for m in ms] for ms in cols[5]
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(list(c), pa.int64()) for c in cols[:4]],
                    pa.array([",".join(c) for c in cols[4]], pa.string()),
                    pa.array(listed, match_type),
                    pa.array([",".join(c) for c in cols[6]], pa.string()),
                    pa.array(list(cols[7]), pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches", "labels", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "matches array<struct<first_word:bigint,last_word:bigint,label:string,containment:double>>, "
        "labels string, score double",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return license_scan(table(spark, sf_dir, "documents")).drop("matches")
