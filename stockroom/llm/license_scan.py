"""Operator 2: licence scan by sparse TF-IDF cosine and directory inheritance.

Windows of a template's number of words slide over the whole text, by one word.  A window
is a sparse vector of its words, weighted by count and by inverse document frequency over all
documents (a word of no template weighs as one that no document has).  Its cosine to the
template decides, if the distinguishing terms agree (names, versions, Lesser, Affero,
NonCommercial, ShareAlike, NoDerivatives): a text carries the licence of its best window at
``SIMILARITY`` or more (ties: the first template).  Only a
text that is named as a licence file covers its directory.  Texts without an
own licence inherit that of the nearest ancestor directory with a licence file: paths are
joined by their ancestor prefixes and the deepest match is taken.

Defined results: null or empty texts and texts without a template word carry nothing; a
null path has no ancestors; of several licence files in a directory the smallest licence
name counts; repeated rows are treated alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm.common import slices, table, words_of
from stockroom.session import ScratchTable, checked_broadcast

SIMILARITY = 0.6
FILE_NAME = "(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
TEXT_BYTES = 4_000_000

# Opening sentences of public licences and their identifiers.
TEMPLATES = {
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "This work is licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public License Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright under CC0 1.0", "Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "GPL-1.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL-2.0-or-later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Released under the MIT License", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
}
for _version, _date in (("2", "June 1991"), ("3", "29 June 2007")):
    TEMPLATES[f"GPL-{_version}.0"] = [f"under the terms of the GNU General Public License as published by the Free Software Foundation, either version {_version} of the License", f"This work is licensed under the GNU General Public License, version {_version}", f"GNU General Public License Version {_version}, {_date}", f"Licensed under the GPLv{_version}", f"SPDX-License-Identifier: GPL-{_version}.0"]
for _version in ("2.1", "3.0"):
    _short = _version.removesuffix(".0")
    TEMPLATES[f"LGPL-{_version}"] = [f"under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version {_short} of the License", f"This work is licensed under the GNU Lesser General Public License, version {_short}", f"GNU Lesser General Public License Version {_short}", f"SPDX-License-Identifier: LGPL-{_version}"]
for _short, _long in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _kind in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{_short}-{_version}"] = [f"This work is licensed under a Creative Commons {_long} {_version} {_kind} License", f"Licensed under CC {_short} {_version}", f"SPDX-License-Identifier: CC-{_short}-{_version}"]
ANCHORS = re.compile(r"licen[sc]e|permission|redistribut|free software|creative commons|unencumbered|\bcc0|\bcc[ -]by|gplv", re.I)
RELATIVES = {"lesser": "lesser", "library": "lesser", "affero": "affero", "noncommercial": "nc", "nc": "nc", "sharealike": "sa", "sa": "sa", "noderivatives": "nd", "noderivs": "nd", "nd": "nd"}
NAMES = frozenset("agpl apache bsd cc cc0 commons eclipse epl gnu gpl gplv2 gplv3 isc lgpl mit mozilla mpl unencumbered unlicense".split())
VERSION = re.compile(r"v?(\d{1,2}(?:\.\d+)*?)(?:\.0)?")
NEAR, FAR = 3, 16  # words after a window in which its terms may stand, and in which a version speaks against a template without one


def marks(term: str) -> set[str]:
    """Distinguishing terms in a word."""

    found = set()
    for part in term.split("-"):
        if part in RELATIVES or part in NAMES:
            found.add(RELATIVES.get(part, part))
        elif version := VERSION.fullmatch(part):
            found.add("v" + version[1])
    return found


def terms(text: str) -> list[str]:
    return re.findall(r"[\w.+-]*\w", text.lower())


VECTORS = [(name, Counter(terms(line))) for name in sorted(TEMPLATES) for line in TEMPLATES[name]]
TERMS = sorted({term for _, vector in VECTORS for term in vector})
NUMBER = {term: i for i, term in enumerate(TERMS)}


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that have each template term; a row per task and term is summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total, found = {term: i for i, term in enumerate(TERMS)}, 0, np.zeros(len(TERMS), np.int64)
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                words = words_of(part.column(0))
                of = np.array([number.get(w.decode("utf-8", "replace").strip(".,;:!?\"'()"), -1) for w in words.distinct] or [-1])
                owner = np.repeat(np.arange(part.num_rows), np.diff(words.starts))
                code = of[words.codes] if len(owner) else np.empty(0, np.int64)
                pairs = np.unique(owner[code >= 0] * len(TERMS) + code[code >= 0])
                found += np.bincount(pairs % len(TERMS), minlength=len(TERMS))
                total += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*TERMS, ""]), pa.array([*found.tolist(), total], pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {row.term: row.n for row in rows}
    return found.pop("", 0), found


@dataclass
class Template:
    license: str
    vector: np.ndarray  # weight by term number, 0 for a word of no template
    norm: float
    words: int
    marks: set[str]


def templates(weight: np.ndarray) -> list[Template]:
    out = []
    for name, counts in VECTORS:
        vector = np.zeros(len(TERMS) + 1)
        for term, n in counts.items():
            vector[NUMBER[term]] = n * weight[NUMBER[term]]
        out.append(Template(name, vector, float(np.sqrt((vector**2).sum())), counts.total(), set().union(*map(marks, counts))))
    return out


def best_window(text: str, weight: np.ndarray, known: list[Template]) -> tuple[str | None, float]:
    """Licence and cosine of the best window whose distinguishing terms agree."""

    if not ANCHORS.search(text):
        return None, 0.0
    words = terms(text)
    code = np.array([NUMBER.get(word, len(TERMS)) for word in words], np.int64)
    weights = weight[code]
    squares = np.concatenate([[0.0], np.cumsum(weights**2)])
    at: dict[str, np.ndarray] = {}  # running count of each distinguishing term
    told_apart = set(RELATIVES.values()).union(*(template.marks for template in known))
    for place, word in enumerate(words):
        for mark in marks(word):
            if mark not in told_apart:  # no template has it: one count for all such, versions apart
                mark = "v other" if mark.startswith("v") else "other"
            at.setdefault(mark, np.zeros(len(words) + 1, np.int64))[place + 1] += 1
    at = {mark: np.cumsum(n) for mark, n in at.items()}
    best: tuple[str | None, float, int] = (None, 0.0, 0)
    for template in known:
        if not template.marks <= at.keys():
            continue
        size = min(template.words, len(words))
        start = np.arange(len(words) - size + 1)
        near, far = np.minimum(start + size + NEAR, len(words)), np.minimum(start + size + FAR, len(words))
        agree = np.ones(len(start), bool)
        for mark, n in at.items():
            if mark in template.marks:
                agree &= n[near] > n[start]
            elif mark in RELATIVES.values():
                agree &= n[near] == n[start]
            else:
                agree &= n[start + size] == n[start]
                if mark.startswith("v") and template.license.endswith("-or-later"):
                    agree &= n[far] == n[start]
        start = start[agree]
        product = np.concatenate([[0.0], np.cumsum(template.vector[code] * weights)])
        dot = product[start + size] - product[start]
        # a word that a window repeats only makes its norm larger
        most = dot / (np.sqrt(squares[start + size] - squares[start]) * template.norm)
        for i in np.argsort(-most, kind="stable"):
            if most[i] <= best[1]:
                break
            counts = np.bincount(code[start[i] : start[i] + size], minlength=len(TERMS) + 1)
            known_part = float(((counts * weight)[:-1] ** 2).sum())
            others = Counter(word for word, c in zip(words[start[i] : start[i] + size], code[start[i] : start[i] + size], strict=True) if c == len(TERMS))
            cosine = float(dot[i]) / (math.sqrt(known_part + sum((n * weight[-1]) ** 2 for n in others.values())) * template.norm)
            if cosine > best[1] + 1e-9:
                best = (template.license, cosine, int(start[i]))
    if best[1] < SIMILARITY:
        return None, best[1]
    name = best[0]
    if name == "BSD-3-Clause" and "with or without modification" in (after := " ".join(words[best[2] :])):
        # the same opening sentence: the clauses that follow it tell which
        if "all advertising materials" in after:
            name = "BSD-4-Clause"
        elif "this software is provided by" in after and "neither the name" not in after:
            name = "BSD-2-Clause"
    return name, min(1.0, best[1])


def scan(docs: DataFrame, weigh_by: DataFrame | None = None) -> DataFrame:
    """Per row of (doc_id, text, path): doc_id, license, similarity, inherited, license_dir, path.

    Terms weigh by how many rows of ``weigh_by`` (default: ``docs``) have them.
    """

    total, found = document_frequencies(docs if weigh_by is None else weigh_by)
    weight = np.array([math.log((1 + total) / (1 + found.get(term, 0))) + 1 for term in [*TERMS, ""]])
    known = templates(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                rows = [best_window(text or "", weight, known) for text in part.column(1).to_pylist()]
                license_, similarity = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(license_, pa.string()), pa.array(similarity, pa.float64())], names=["doc_id", "path", "own", "similarity"])

    scanned = ScratchTable(docs.select("doc_id", "text", "path").mapInArrow(run, "doc_id long, path string, own string, similarity double"), "licence-scan").df
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    covering = checked_broadcast(scanned.where(F.col("own").isNotNull() & F.col("path").rlike(FILE_NAME)).groupBy(parent.alias("dir")).agg(F.min("own").alias("dir_license")))
    # one row per directory and ancestor, not per document
    folders = scanned.where("path is not null").select(parent.alias("folder")).distinct()
    ancestors = folders.select("folder", F.expr("explode(transform(sequence(1, size(split(folder, '/'))), k -> substring_index(folder, '/', k)))").alias("dir"))
    nearest = ancestors.join(covering, "dir").groupBy("folder").agg(F.max(F.struct(F.length("dir"), "dir", "dir_license")).alias("near"))
    joined = scanned.withColumn("__folder", parent).join(checked_broadcast(nearest), F.col("__folder") == F.col("folder"), "left")
    inherited = F.col("own").isNull() & F.col("near").isNotNull()
    return joined.select("doc_id", F.coalesce("own", "near.dir_license").alias("license"), "similarity", inherited.alias("inherited"), F.when(inherited, F.col("near.dir")).alias("license_dir"), "path")


def url_path(url: str) -> Column:
    """Host and path of a URL, the folders that a page lies in; scheme, query, fragment and a last slash left out."""

    return F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", ""), "/+$", "")


def page_text(html: str) -> Column:
    """All text of a page, notices in its footer too: scripts, styles, comments and tags become line ends."""

    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|</?[a-z!][^>]*>", "\n")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages in one scan, weighed by the documents.

    Documents have no path: each carries its own licence, and none inherits.  Pages have the path of their
    URL and inherit from licence files above them.  A page's row has no doc_id, a document's no page_id.
    """

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("path"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), page_text("html").alias("text"), F.coalesce(url_path("url"), F.lit("")).alias("path"))
    scanned = scan(docs.unionByName(pages), docs)
    # a page without a URL has the empty path, a document none
    is_page = F.col("path").isNotNull()
    return scanned.select(
        F.when(~is_page, F.col("doc_id")).alias("doc_id"),
        "license",
        "similarity",
        "inherited",
        "license_dir",
        F.when(is_page, F.col("doc_id")).alias("page_id"),
        "path",
    )
