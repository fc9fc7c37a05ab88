"""Licence scan: own headers, inheritance from the nearest directory, defined edge cases."""

from stockroom.llm import license_scan


def test_headers_and_inheritance(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [
        (1, "code here and there\nLicensed under the Apache License, Version 2.0.\nmore code", "a/b/x.py"),
        (2, mit, "a/LICENSE"),
        (3, "no header at all", "a/b/c/y.py"),
        (4, "Redistribution and use in source and binary forms, with or without modification, are permitted", "a/b/c/LICENSE"),
        (5, "plain", "z/y.py"),
        (6, None, None),
        (7, "", "a/q.py"),
        (8, "the licence plate was stolen from an old car", "z/q.py"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.license, r.inherited, r.license_dir) for r in license_scan.scan(docs).collect()}
    assert got[1] == ("Apache-2.0", False, None)
    assert got[2] == ("MIT", False, None)
    assert got[3] == ("BSD-3-Clause", True, "a/b/c")
    assert got[7] == ("MIT", True, "a")
    assert got[5] == got[6] == got[8] == (None, False, None)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_query_scans_pages_and_inherits_along_their_urls(spark, tmp_path):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    docs = [(1, "Licensed under the Apache License, Version 2.0."), (2, "no header"), (3, None)]
    pages = [
        (1, "https://host.example/src/LICENSE?raw=1", f"<html><body><p>{mit}</p></body></html>"),
        (2, "http://host.example/src/deep/er/page.html#top", "<p>plain</p>"),
        (3, "https://host.example/other/", "<p>plain</p><script>Licensed under the Apache License, Version 2.0</script>"),
        (4, "https://host.example/src/own", "<p>text</p><footer>Released under the <b>ISC</b> License</footer>"),
        (5, None, None),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = license_scan.op2_license_scan(spark, str(tmp_path)).collect()
    got = {("page", r.page_id) if r.doc_id is None else ("doc", r.doc_id): (r.license, r.inherited, r.license_dir) for r in rows}
    assert len(rows) == 8
    assert got["doc", 1] == ("Apache-2.0", False, None)
    assert got["doc", 2] == got["doc", 3] == got["page", 3] == got["page", 5] == (None, False, None)
    assert got["page", 1] == ("MIT", False, None)
    assert got["page", 2] == ("MIT", True, "host.example/src")
    assert got["page", 4] == ("ISC", False, None)
