import re

from servops.llm import licenses
from . import common


def scan(spark, texts, **kw):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in licenses.scan_licenses(common.docs(spark, rows), **kw).collect()}


def test_phrases_and_templates(spark):
    got = scan(spark, [
        "Under the MIT  License; the mit-license. General Public License",
        "x\nLicensed under CC BY NC 4.0 now\ny", "Licensed under\nCC BY-NC 4.0", None, "", "MIT LICENSE",
        "permission is hereby granted, free of charge, to any person who gets a copy of this software",
        "mit\xa0license", "mit é license", "the gnu public work is licensed under general license version"])
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (10, 3, 2, 7)
    assert got[0]["base_labels"] == "gpl,mit" and got[0]["score"] == 1.0
    assert got[1]["labels"] == "cc-by-nc" and got[1]["base_labels"] == "" and got[1]["score"] == 1.0  # not cc-by-sa
    assert got[1]["n_base"] == 0 and got[1]["first_word"] is None
    assert got[2]["labels"] == "cc-by-nc" and got[2]["score"] == 1.0  # over two lines
    for k in (3, 4):
        assert (got[k]["n_words"], got[k]["n_base"], got[k]["labels"], got[k]["score"]) == (0, 0, "", 0.0)
    assert got[5]["labels"] == "mit" and got[5]["n_base"] == 1
    assert got[6]["labels"] == "mit" and 0.8 <= got[6]["score"] < 1
    assert got[7]["n_words"] == 1 and got[7]["n_base"] == 0  # a no-break space is no separator
    assert got[8]["n_base"] == 0
    assert got[9]["labels"] == "gpl" and got[9]["score"] < 1  # nine of eleven words


def test_filters_lose_nothing(spark):
    """The filtered join against every pair of line and template."""
    import random
    random.seed(2)
    words = sorted({w for _, _, ws in licenses.template_words() for w in ws})
    texts = []
    for _ in range(150):
        _, _, ws = random.choice(licenses.template_words())
        line = [w for w in ws if random.random() < 0.9] + random.sample(words, random.randint(0, 6)) + ["zzz"] * random.randint(0, 2)
        random.shuffle(line)
        for at in random.sample(range(len(line)), len(line) // 6):
            line[at] += random.choice(["\n", "\n\n", " \n# "])
        texts.append("intro\n" + " ".join(line))
    for threshold in (0.5, 0.8, 1.0):
        got = scan(spark, texts, threshold=threshold)
        for i, t in enumerate(texts):
            best = plain(t, threshold)
            assert got[i]["labels"] == ",".join(sorted(set(best) | set(filter(None, got[i]["base_labels"].split(",")))))
            if not got[i]["n_base"]:
                assert got[i]["score"] == max(best.values(), default=0.0)


def plain(text, threshold):
    """Label -> best containment over all pairs of block and template, read plainly."""
    lines = [re.findall("[a-z0-9]+", line.lower()) for line in text.split("\n")]
    best = {}
    for k, line in enumerate(lines):
        held = set(line + [w for after in lines[k + 1:] for w in after][:licenses.reach()])
        for _, label, ws in licenses.template_words():
            share = len(held & set(ws)) / len(ws)
            if share >= threshold and held.issuperset(licenses.required_words(label, ws)):
                best[label] = max(best.get(label, 0), share)
    return best


def test_two_labels_on_one_line(spark):
    apache, bsd = "Licensed under the Apache License, Version 2.0", "redistribution and use in source and binary forms with or without modification are"
    got = scan(spark, [f"{apache} {bsd}", f"{bsd} {apache}", "Licensed under CC BY-NC 4.0, parts under CC BY-SA 4.0",
                       "licensed under the GNU general license version 2.0", "released under the BSD license"])
    assert got[0]["labels"] == got[1]["labels"] == "apache,bsd"
    assert got[2]["labels"] == "cc-by-nc,cc-by-sa" and got[3]["labels"] == got[4]["labels"] == ""


def test_wrapped_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mit = "# Permission is hereby granted, free of charge,\n#\n# to any person obtaining\n#   a copy of this software and"
    words = "\n\n".join("Licensed under the Apache License, Version 2.0".split())
    far = "Licensed under the Apache\n" + "word " * licenses.reach() + "\nLicense, Version 2.0"
    texts = [bsd, mit, words, "\n \n" + words.replace("\n", "\r\n") + "\n", far, "x " * 30000 + "\n" + bsd]
    got = scan(spark, texts)
    assert [got[k]["labels"] for k in range(6)] == ["bsd", "mit", "apache", "apache", "", "bsd"]
    assert all(got[k]["labels"] == ",".join(sorted(plain(t, 0.8))) for k, t in enumerate(texts) if not got[k]["n_base"])


def test_edges(spark):
    got = licenses.scan_licenses(common.docs(spark)).collect()
    assert len(got) == len(common.ROWS)
    assert licenses.scan_licenses(common.empty(spark)).count() == 0
    none = scan(spark, ["Licensed under CC BY-NC 4.0", "mit license"], templates=[])
    assert none[0]["labels"] == "" and none[1]["labels"] == "mit"


def test_no_python_on_the_executors(spark):
    plan = licenses.scan_licenses(common.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
