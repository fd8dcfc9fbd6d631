import itertools
import random
import re

import numpy as np
import pyarrow as pa

from servops.llm import decontam
from servops.llm.textarrays import byte_view
from . import common

ITEM = "Anna has 3 red apples and gives Bob 12 kg of flour every day, so Anna keeps 3 of them."


def plain(text):
    """Token kinds by a regular expression and a loop."""
    out = []
    end, number_before = 0, False
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*(?![0-9A-Za-z\x80-\U0010FFFF])|[0-9A-Za-z\x80-\U0010FFFF]+", text):
        gap, w = text[end:m.start()], m[0]
        inside = bool(out) and not re.search(r"[.!?:;\n\r\"]", gap)
        if w[0].isdigit() and w[-1].isdigit():
            kind = "num"
        elif number_before and w.lower() in decontam.UNITS:
            kind = "unit"
        elif inside and re.match("[A-ZÀ-Þ]", w):
            kind = "name"
        else:
            kind = re.sub("[A-Z]", lambda x: x[0].lower(), w)
        out.append(kind)
        number_before = kind == "num"
        end = m.end()
    return out


def test_canonical_tokens():
    texts = [ITEM, "", "3.5 km, 4,5 kg and 7 m in the Élan. New York! 12", "a1 1a 3.x 1.2.3", "Zürich ist In Ulm 5 kg", "x\nNew line Here"]
    data, off = byte_view(pa.array(texts))
    code, value, slot, first = decontam.canonical(data, off)
    names = {int(decontam._NUM): "num", int(decontam._UNIT): "unit", int(decontam._NAME): "name"}
    for i, t in enumerate(texts):
        want = plain(t)
        got = code[first[i]:first[i + 1]].tolist()
        assert [names.get(c, None) for c in got] == [w if w in ("num", "unit", "name") else None for w in want], t
        assert slot[first[i]:first[i + 1]].tolist() == [w in ("num", "unit", "name") for w in want]


def find(spark, texts, items):
    df = common.docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.find_items(df, bench).collect()}


def test_verbatim_and_new_parameters(spark):
    other = "So Eve has 7 red apples and gives Tom 4.5 kg of flour every day, so Eve keeps 7 of them."
    mixed = "So Eve has 7 red apples and gives Tom 4.5 kg of flour every day, so Jim keeps 9 of them."
    changed = "She sold all green pears at the market and bought three old books about the history of bread."
    got = find(spark, ["start " + ITEM + " end", "text before. " + other + " more", mixed, changed, None, "", "Anna has 3",
                       ITEM, ITEM], [ITEM, None, "", "a b"])
    # of the mixed passage, the largest consistent set of slots is found, which covers fewer windows
    assert set(got) == {(0, 0), (1, 0), (2, 0), (7, 0), (8, 0)}
    assert got[0, 0]["verbatim"] and not got[1, 0]["verbatim"] and not got[2, 0]["verbatim"]
    assert got[2, 0]["n_windows"] < got[1, 0]["n_windows"]
    assert got[7, 0]["coverage"] == 1.0 and got[1, 0]["coverage"] > 0.8


def test_assignment_against_all():
    rng = np.random.default_rng(3)
    for _ in range(300):
        rows, more = int(rng.integers(1, 5)), int(rng.integers(0, 3))
        w = rng.integers(0, 6, (rows, rows + more))
        got = decontam.assign(w)
        assert len(set(got.tolist())) == rows
        assert w[np.arange(rows), got].sum() == max(sum(w[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(rows + more), rows))


def tokens(text):
    """(kind, value) of the tokens, with kinds as in ``plain``."""
    words = re.findall(r"[0-9]+(?:[.,][0-9]+)*(?![0-9A-Za-z\x80-\U0010FFFF])|[0-9A-Za-z\x80-\U0010FFFF]+", text)
    return list(zip(plain(text), (w.lower() for w in words)))


def slow_find(doc, item, width=8):
    """What numbers of windows a document may be said to hold of an item, by all one-to-one sets of every alignment, and
    for each the share that counts. Several only where sets weigh the same."""
    d, t = tokens(doc), tokens(item)
    width = min(width, len(t))
    slot = ("num", "unit", "name")
    places = range(len(t) - width + 1)
    plain_at = {a for a in places if sum(k not in slot for k, _ in t[a:a + width]) >= min(4, width)}
    every = plain_at | set(places)
    options = [frozenset()]
    for shift in range(-len(t), len(d)):
        sure, filled = set(), {}
        for a in places:
            x, y = t[a:a + width], d[max(0, a + shift):a + shift + width] if a + shift >= 0 else []
            if len(y) < width:
                continue
            if [v for _, v in x] == [v for _, v in y]:
                sure.add(a)
            if a in plain_at and [k for k, _ in x] == [k for k, _ in y]:
                filled[a] = {(p, q) for (k, p), (_, q) in zip(x, y) if k in slot}
                if all(p == q for p, q in filled[a]):
                    sure.add(a)
        pairs = sorted(set().union(*filled.values()))
        best, here = (-1, -1), set()
        for n in range(len(pairs) + 1):
            for some in itertools.combinations(pairs, n):
                if len({p for p, _ in some}) < n or len({q for _, q in some}) < n:
                    continue
                weight = sum(p in f for p in some for f in filled.values()), sum(p == q for p, q in some)
                covered = frozenset(sure | {a for a, f in filled.items() if f <= set(some)})
                if weight > best:
                    best, here = weight, set()
                if weight == best:
                    here.add(covered)
        options = list({o | h for o in options for h in here})
    found = set()
    for o in options:
        coverage = max(len(o) / len(every), len(o & plain_at) / len(plain_at) if plain_at else 0)
        found.add((len(o), round(coverage, 9)) if coverage >= decontam.SHARE or len(o) >= decontam.ENOUGH else None)
    return found


def test_against_all_slot_sets(spark):
    rng = random.Random(5)
    words = ["red", "apples", "and", "gives", "of", "flour", "each", "day", "so", "keeps"]
    values = {"num": ["3", "7", "9", "4.5"], "name": ["Anna", "Bob", "Eve"]}

    def item():
        out = [rng.choice(words) for _ in range(rng.randint(9, 16))]
        for at in rng.sample(range(1, len(out)), 4):
            out[at] = rng.choice(values[rng.choice(["num", "name"])])
        return out

    def copy(x):
        names = {v: rng.choice(vs) for vs in values.values() for v in vs}
        out = [names[w] if w in names and rng.random() < 0.5 else w for w in x]
        return [rng.choice(values["num"]) if w in values["num"] and rng.random() < 0.3 else w for w in out]
    items = [item() for _ in range(12)]
    texts = ["so " + " ".join(copy(rng.choice(items))) + " then " + " ".join(copy(rng.choice(items))) for _ in range(60)]
    items = [" ".join(x) for x in items]
    got = find(spark, texts, items)
    at_odds = 0
    for i, text in enumerate(texts):
        for k, one in enumerate(items):
            want = slow_find(text, one)
            row = got.get((i, k))
            assert ((row["n_windows"], round(row["coverage"], 9)) if row else None) in want, (text, one)
            at_odds += row is not None and row["coverage"] < 1 and not row["verbatim"]
    assert at_odds >= 10


def test_one_altered_value_hides_no_identical_windows(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    words[10], words[50] = "3", "3"
    item = " ".join(words)
    altered, swapped = [*words], [*words]
    altered[50] = "9"  # 3 -> 3 and 3 -> 9
    words[30] = "17"
    swapped[30] = "3"  # another value of the item
    got = find(spark, [" ".join(altered), " ".join(swapped)], [item, " ".join(words)])
    assert set(got) >= {(0, 0), (1, 1)}
    assert got[0, 0]["n_windows"] == 53 - 8 and not got[0, 0]["verbatim"]
    assert got[1, 1]["n_windows"] == 53 - 8 and not got[1, 1]["verbatim"]


def test_verbatim_copies_of_items_rich_in_slots_or_short(spark):
    items = ["What is 17 times 23?", "Jim met Bob, Tom, Eve and Ann at 3, 4, 5 and 6 in Rome, Bonn, Oslo and Lima", "Add 2 and 2",
             "The capital of France is called Paris"]
    texts = ["so we ask what is 17 times 23 again", "Then " + items[1] + " again", "now Add 2 and 2 please",
             "and The capital of France is called Paris they said", "what is 17 times 24", "Add 2 and 3"]
    got = find(spark, texts, items)
    assert set(got) == {(i, i) for i in range(4)}
    assert all(r["coverage"] == 1.0 and r["verbatim"] for r in got.values())


def test_short_items_and_parts(spark):
    short = "what is the capital of France"  # one window of its own length
    long = " ".join(f"tok{i}" for i in range(60))
    got = find(spark, ["we ask: What is the capital of France now", "x " + long + " y", " ".join(f"tok{i}" for i in range(20, 45)),
                       " ".join(f"tok{i}" for i in range(10))], [short, long])
    assert set(got) == {(0, 0), (1, 1), (2, 1)}
    assert got[1, 1]["coverage"] == 1.0 and got[2, 1]["n_windows"] == 18


def test_data_against_substring_search(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    from servops.llm.queries import QUERIES
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, sf).collect()}
    want = set(duckdb.sql(f"select doc_id, item_id from '{sf}/documents.parquet' d, '{sf}/benchmark.parquet' b "
                          "where contains(d.text, b.text)").fetchall())
    assert want <= got and len(got - want) <= 2


def test_edges(spark):
    bench = spark.createDataFrame([(None, ITEM), (1, None), (2, "the quick brown fox jumps over the lazy dog and runs into the green forest")],
                                  "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.find_items(common.docs(spark), bench).collect())
    assert got == [(1, 2), (2, 2)]
    assert decontam.find_items(common.empty(spark), bench).count() == 0
    assert decontam.find_items(common.docs(spark), bench.limit(0)).count() == 0
