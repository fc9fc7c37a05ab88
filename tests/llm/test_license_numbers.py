"""A long table of numbers beside a licence notice takes memory by its length only."""

import tracemalloc

import numpy as np

from stockroom.llm import license_scan


def test_many_distinct_numbers():
    weight = np.ones(len(license_scan.TERMS) + 1)
    known = license_scan.templates(weight)
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    alone = license_scan.best_window(notice, weight, known)
    numbers = " ".join(f"{n}.{n % 97}" for n in range(50_000))
    tracemalloc.start()
    found = license_scan.best_window(f"{notice}\n{numbers}\nMIT License", weight, known)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == alone[0]
    assert most < 200e6
