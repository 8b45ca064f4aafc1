from tests.comparing import connect, same
from tests.conftest import SMALL
from tests.llm.conftest import ODD
from verivane.llm import license_scan as l


def test_same_as_sql(spark):
    same(l.op9_license_scan(spark, SMALL), connect(SMALL), l.ORACLE_SQL["op9_license_scan"])


def test_places_and_blocks(docs):
    rows = [
        (1, "The MIT License, and the mit\nLICENSE! Summit license; mit licensee"),
        (2, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        (3, "redistribution and use in source forms are permitted"),
        (4, "GNU General Public  License / Apache-License"),
        (5, "Licensed under CC BY-NC 4.0.\nx"),
    ]
    got = {r["doc_id"]: r for r in l.scan(docs(rows + [(i + 10 if i is not None else None, t) for i, t in ODD])).collect()}
    assert tuple(got[1])[1:7] == (11, 2, 1, 5, "mit", "mit")
    assert (got[2]["base_labels"], got[2]["labels"], got[2]["score"]) == ("", "bsd", 1.0)
    assert got[3]["labels"] == "" and got[3]["score"] == 0.0
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"], got[4]["base_labels"]) == (2, 1, 4, "apache,gpl")
    assert got[5]["labels"] == "cc-by-nc" and got[10]["n_words"] == 0 and got[10]["first_word"] is None
    assert l.scan(docs([])).collect() == []


def test_every_pair_at_the_threshold(docs):
    """Against comparing all lines with all templates, for lines with words left out of each template."""
    import math
    import random
    import re

    rng = random.Random(3)
    lines = []
    for _, t in l.TEMPLATES:
        w = t.split()
        for _ in range(25):
            lines.append(" ".join(x for x in w if rng.random() < 0.85) + " " + " ".join(rng.choice("of the and zebra".split()) for _ in range(rng.randrange(5))))
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in l.scan(docs(lines)).collect()}
    for i, line in enumerate(lines):
        own = set(line.split())
        want = {label for label, t in l.TEMPLATES if len(own & set(t.split())) >= math.ceil(l.THRESHOLD * len(set(t.split())) - 1e-9)}
        want |= {label for p, label in l.PHRASES if re.search(rf"\b{p}\b", line)}
        assert got[i] == want, line


def test_notices_wrapped_over_lines(docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
    narrow = "\r\n".join(l.TEMPLATES[5][1].split())
    apart = ["\n".join(x + " zebra" * 40 for x in l.TEMPLATES[5][1].split()), "released by all\n" + "zebra " * 9 + "\nunder the license"]
    got = [(r["labels"], r["score"]) for r in sorted(l.scan(docs([mit, bsd, f"{'zebra ' * 50}\n{narrow}\nzebra", *apart])).collect(), key=lambda r: r["doc_id"])]
    assert got == [("mit", 1.0), ("bsd", 1.0), ("bsd", 1.0), ("", 0.0), ("", 0.0)]


def test_wrapped_notices_same_as_sql(spark, docs, tmp_path):
    """The twin has the same windows: notices with line ends anywhere, words left out and words between."""
    import random

    import duckdb

    rng = random.Random(6)
    texts = [None, "", "\n", "mit license\nmit\nlicense"]
    for _, t in l.TEMPLATES:
        for gap in (0.0, 0.1, 0.3):
            w = [x + (rng.choice((" zebra", " the", "")) if rng.random() < gap else "") for x in t.split() if rng.random() < 0.9]
            texts.append("".join(x + rng.choice((" ", " ", "\n", "\r\n# ")) for x in w) + "\nend")
    df = docs(texts)
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    same(l.scan(df), c, l.ORACLE_SQL["op9_license_scan"])
    assert sum(r["labels"] != "" for r in l.scan(df).collect()) > 12


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "released under the mit license", 3, 4, 5), (1, "released under the mit license", 3, 4, 5)], "doc_id long, text string, h long, g long, n_words long")
    assert [(r["doc_id"], r["n_words"], r["labels"]) for r in l.scan(df).collect()] == [(1, 5, "mit")] * 2
