"""Packing against a direct reading of its rule, and the properties of all bins."""

import random
from collections import defaultdict

from termtrail.llm import packing

SCHEMA = "doc_id long, text string, source string, bin int, grp string"


def plain(lengths, sources, clusters, capacity):
    """Largest first; each piece into the fullest bin that can take it, the oldest of equal ones."""
    pieces = sorted(((min(capacity, n - s), i, s) for i, n in enumerate(lengths) for s in (range(0, n, capacity) if n else (0,))),
                    key=lambda p: (-p[0], p[1], p[2]))
    bins, out = [], []
    for size, row, start in pieces:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= max(size, 1) and sources[row] not in b["s"] - {None}
                and clusters[row] not in b["c"] - {None}]
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
            fits = [(capacity, len(bins) - 1)]
        b = bins[min(fits)[1]]
        out.append((row, start, size, min(fits)[1], capacity - b["left"]))
        b["left"] -= size
        b["s"].add(sources[row])
        b["c"].add(clusters[row])
    return out


def test_matches_the_rule():
    rnd = random.Random(5)
    for _ in range(30):
        n = rnd.randrange(0, 120)
        lengths = [rnd.choice((0, 1, 10, 64, 65, 300, rnd.randrange(64))) for _ in range(n)]
        sources = [rnd.choice(("hot", "hot", "a", "b", None)) for _ in range(n)]
        clusters = [rnd.choice((1, 2, None, i)) for i in range(n)]
        assert packing.pack_group(lengths, sources, clusters, 64) == plain(lengths, sources, clusters, 64)


def test_all_pieces_once_and_no_conflict(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(("the", "of", "zq")) for _ in range(rnd.choice((0, 3, 40, 400)))), rnd.choice("aaab"), 1, "x")
            for i in range(300)]
    rows += [(300, None, None, 1, "x"), (None, "a b", "a", 1, "x")] + [(301, "same text", "c", 1, "x")] * 5
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=128).collect()
    bins, tokens = defaultdict(list), defaultdict(int)
    for r in got:
        bins[r.grp, r.bin].append(r)
        tokens[r.doc_id] += r.n_tokens
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.offset)
        assert all(x.offset + x.n_tokens == y.offset for x, y in zip(pieces, pieces[1:])) and pieces[0].offset == 0
        assert pieces[-1].offset + pieces[-1].n_tokens <= 128
        for name in ("source", "cluster"):
            held = [r[name] for r in pieces if r[name] is not None]
            assert len(held) == len(set(held))
    encode = packing.token_file.encoder().encode
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        assert tokens[doc_id] == (len(encode([text])[0]) // 4 + 1) * (5 if doc_id == 301 else 1)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_white_space_variants_and_near_copies_share_no_bin(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (2, text.replace(" ", " \t\r\n ").upper() + " \n", "b"), (3, text + " tail", "c"), (None, f" {text}", "d"),
            (5, "Äpfel", "e"), (6, "äPFEL ", "f"), (7, "of the", "g"), (8, None, "h"), (9, " \n", "i"), (8, "", "j"),
            (10, text.upper(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = packing.query(spark, str(tmp_path)).collect()
    cluster = {r.source: r.cluster for r in found}
    assert len(found) == len(rows) and len({cluster[s] for s in ("a", "b", "c", "d", None)}) == 1
    assert cluster["e"] == cluster["f"] and len({cluster[s] for s in "aeg"}) == 3 and not any(cluster[s] for s in "hij")
    bins = [(r.grp, r.bin) for r in found if r.cluster == cluster["a"]]
    assert len(bins) == len(set(bins)) == 5
    spaced = packing.pack(docs.where("source IN ('a', 'b')")).collect()
    assert len({(r.grp, r.bin) for r in spaced}) == 2
