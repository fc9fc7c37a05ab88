"""Licence scan: notices inside longer lines, related licences, licence files only, several directory levels."""

import numpy as np

from stockroom.llm import license_scan
from stockroom.llm.license_scan import TERMS, best_window, templates

WEIGHT = np.full(len(TERMS) + 1, 5.0)
KNOWN = templates(WEIGHT)
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"


def of(text):
    return best_window(text, WEIGHT, KNOWN)[0]


def test_notice_within_a_line():
    assert of(MIT + ' and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software') == "MIT"
    assert of('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.') == "Apache-2.0"
    assert of("Some words of the page come first and then it is licensed under CC BY-NC 4.0 and the page goes on") == "CC-BY-NC-4.0"


def test_relatives_keep_their_names():
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    assert of(gnu.format("General Public", "3")) == "GPL-3.0"
    assert of(gnu.format("General Public", "2")) == "GPL-2.0"
    assert of(gnu.format("Lesser General Public", "2.1")) == "LGPL-2.1"
    assert of(gnu.format("Affero General Public", "3")) == "AGPL-3.0"
    assert of("Licensed under CC BY-SA 4.0.") == "CC-BY-SA-4.0"
    assert of("Licensed under CC BY-ND 3.0.") == "CC-BY-ND-3.0"
    assert of("Licensed under the Apache License, Version 1.1") is None
    assert of("Released under the Foo License.") is None


def test_only_licence_files_cover_a_directory(spark):
    rows = [(1, MIT, "a/notes.txt"), (2, "plain", "a/x.py"), (3, MIT, "b/LICENSE"), (4, "plain", "b/c/d/x.py")]
    got = {r.doc_id: (r.license, r.license_dir) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {1: ("MIT", None), 2: (None, None), 3: ("MIT", None), 4: ("MIT", "b")}
