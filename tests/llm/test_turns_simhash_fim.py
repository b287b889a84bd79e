"""Turn repair, SimHash and fill-in-the-middle against brute force and exact round trips."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import fim, queries, simhash, turns
from ledgerloom.llm.common import table

TURNS = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- conversation structure repair


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text = said(role), said(text)
        h = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's sorted (turn, role, text), by whole lists of edits from the end."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, q, room):
        """(cost, audit, lines) of rows from i, after initials `q`: one of '', s, u, a."""
        found = []
        if i == len(rows) and q in ("", "a"):
            found.append((0, "", ()))
        other = "a" if q == "u" else "u"
        if room:
            c, a, said = best(i, other, room - 1)
            found.append((c + 2, "I" + a, ({"u": "user:", "a": "assistant:"}[other], *said)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, said = best(i + 1, q, 2)
            found.append((c + 3, "D" + a, said))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                c, a, said = best(i + 1, other, 2)
                found.append((c + 2 + late, "R" + a, ({"u": "user:", "a": "assistant:"}[other] + text, *said)))
                if q + role[:1] in ("s", "u", "su", "ua", "au"):
                    c, a, said = best(i + 1, role[:1], 2)
                    found.append((c + late, "K" + a, (f"{role}:{text}", *said)))
        return min(found) if found else (10**9, "", ())

    cost, audit, said = best(0, "", 2)
    told = [t for t, _, _ in rows if t is not None]
    gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(said)))


def brute_digest(rows):
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in brute_damage(rows):
        convs[conv].append((turn, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    return {c: brute_repair(sorted(v, key=key)) for c, v in convs.items()}


def told(frame):
    return {r["conv_id"]: tuple(r)[1:] for r in frame.collect()}


def test_turn_repair_of_given_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = brute_digest(rows)
    assert told(queries.op11_turn_repair(spark, sf)) == want
    assert sum(w[5] for w in want.values()) > 100 and {*"".join(w[6] for w in want.values())} == {*"DIKR"}


def made_turns(seed, convs, most):
    """Turns with odd roles, repeated, blank and cut texts, missing and null turn numbers."""
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        at = rng.choice([0, 0, 3, -5])
        for _ in range(rng.randint(0, most)):
            at += rng.choice([1, 1, 1, 2])
            rows.append((conv, at, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "u2"]), rng.choice(["Hi.", "Yes!", "no", "", " \n", None, "what", f"say {rng.random()}."])))
    return rows


@pytest.mark.parametrize("span,piece", [(4096, 65536), (4, 3), (1, 1)])
def test_turn_repair_over_ranges_and_pieces(spark, span, piece):
    rows = made_turns(span, 60, 14) + [(None, 1, "user", "a."), (None, None, "assistant", None), (900, None, "system", "s."), (900, None, "user", "u"), (900, 2, "assistant", "b.")]
    got = told(turns.digest(turns.damage(spark.createDataFrame(rows, TURNS)), span, piece))
    assert got == brute_digest(rows)


def test_turn_repair_ties_are_least():
    """Every short conversation over four kinds of rows: the automaton's lists of edits are those of whole strings."""
    steps, kinds = turns.Steps(), [("user", "x."), ("assistant", "y."), ("system", "z."), ("tool", "w"), ("user", "")]
    rng = random.Random(7)
    for _ in range(2_000):
        rows = [(i, *kinds[rng.randrange(5)]) for i in range(rng.randint(0, 7))]
        rows = [(i, r, t and t + str(i) + ("." if t.endswith(".") else "")) for i, r, t in rows]
        made = turns._Range(steps, (1, 1, 0), 0, None)
        for i, role, text in rows:
            kind = 2 * "sua".find(role[0]) if role[0] in "sua" else 6
            made.add(i, (i, i), kind + (not text.endswith(".")), role[0], not text, False)
        chain = turns._Chain((1, 1))
        _, _, _, _, n, head, tail, low, high, count, *counts, ends, backs = made.row()
        chain.add(0, 0, n, head, tail, low, high, count, counts, ends)
        (*_, entry, place, inserts, last, gaps, blank, dup, trunc, illegal, cost) = next(chain.rows())
        import zlib as z

        audit = "".join(turns.traced(z.decompress(backs[entry]), place)) + "I" * inserts
        assert (gaps, blank, dup, trunc, illegal, cost, audit) == brute_repair(rows)[:7]


def test_turn_repair_rows_and_edges(spark):
    rows = [(1, 0, "system", "s.", "x"), (1, 1, "assistant", "b.", "x"), (1, 1, "assistant", "b.", "x"), (1, 2, "user", " ", "x"), (2, 0, "user", "w " * 50_000 + ".", "x"), (3, None, None, None, "x")]
    frame = spark.createDataFrame(rows, TURNS + ", at string")
    out = [tuple(r)[:6] for r in turns.repair(frame, 2, 2, 1_000).orderBy("conv_id", "range", "at").collect()]
    assert out == [
        (1, 0, 0, "K", 0, "system"), (1, 0, 1, "I", None, "user"), (1, 0, 2, "K", 1, "assistant"), (1, 0, 3, "D", 1, "assistant"), (1, 1, 0, "D", 2, "user"),
        (2, 0, 0, "K", 0, "user"), (2, 0, 1, "I", None, "assistant"), (3, -(1 << 62), 0, "D", None, " "),
    ]
    giant = made_turns(9, 3, 400)
    whole, cut = (turns.repair(spark.createDataFrame(giant, TURNS), span, 7) for span in (1 << 40, 16))
    told_of = lambda df: [tuple(r) for r in df.orderBy("conv_id", "range", "at").select("conv_id", "edit", "turn", "role", "text").collect()]
    assert told_of(whole) == told_of(cut) and cut.select("range").distinct().count() > 20
    assert turns.digest(spark.createDataFrame([], TURNS)).count() == 0 and turns.repair(spark.createDataFrame([], TURNS)).count() == 0


def test_giant_conversation_is_many_ranges(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t "), F.col("id"), F.lit(".")).alias("text"))
    scanned = turns.scan(turns._rows(rows, 1_000)).select("b", "n").collect()
    assert len(scanned) == 30 and all(r["n"] == 1_000 for r in scanned)
    r = turns.digest(rows, 1_000).first()
    assert (r["cost"], r["audit"], r["illegal"]) == (0, "K" * n, 0)
    assert r["repaired_sha256"] == sha("\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:t {i}." for i in range(n)))


# --- SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    items = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in items]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_simhash_of_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    label = brute_components(fps, 4)
    want = {r["doc_id"]: (f"{fp:016x}", rows[at]["doc_id"]) for r, fp, at in zip(rows, fps, label)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op12_simhash(spark, sf).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    flips = np.zeros(700, np.uint64)
    for _ in range(radius + 2):
        flips ^= np.uint64(1) << rng.integers(0, 64, 700, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base[rng.integers(0, 40, 700)] ^ flips, np.array([0, (1 << 64) - 1], np.uint64)]))
    q, c = simhash.within(fps[:130], simhash.planes_of(fps), len(fps), radius, list(range(64)))
    want = {(i, j) for i in range(130) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert set(zip(q.tolist(), c.tolist())) == want and len(q) == len(want)


@pytest.mark.parametrize("chunk,meet", [(4096, 8192), (16, 8192), (16, 4)])
def test_simhash_links_in_tiles_and_longer_keys(spark, chunk, meet):
    """A dense cluster in few keys, chains, and far fingerprints; small chunks make tiles of two sides, a low `meet` longer keys."""
    rng = random.Random(3)
    fps = [0, -1, 1 << 62]
    for base in [rng.getrandbits(64) for _ in range(30)]:
        for _ in range(12):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    chain = rng.getrandbits(64)
    for i in range(0, 40, 4):
        chain ^= 0b1111 << i
        fps.append(chain)
    fps = sorted({f & ((1 << 64) - 1) for f in fps})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, chunk, meet).collect()
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    label = brute_components(fps, 4)
    groups = {}
    for f, x in zip(signed, label):
        groups.setdefault(x, set()).add(root(f))
    assert all(len(g) == 1 for g in groups.values()) and len({root(f) for f in signed}) == len(groups)


def test_simhash_edges(spark):
    long = " ".join(f"word{i % 977} and{i}" for i in range(200_000))
    assert simhash.fingerprint(long.encode()) & ((1 << 64) - 1) == brute_fingerprint(long)  # over the parts that are split at once
    rows = [(5, None, "x"), (4, "", "x"), (3, " \t", "x"), (2, "Ä b", "x"), (1, "ä b", "x"), (7, "A b C", "x"), (6, "a B c", "x"), (7, "A b C", "x"), (None, "none", "x"), (None, "a b c", "x"), (9, long, "x")]
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    assert {d: c for (d, _), c in got.items() if d} == {5: 3, 4: 3, 3: 3, 2: 2, 1: 1, 7: 6, 6: 6, 9: 9} and sorted(str(c) for (d, _), c in got.items() if d is None) == ["6", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- fill-in-the-middle


def brute_fim(doc_id, text, units):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else (n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def units_of(text, unit):
    return list(text) if unit == "char" else re.findall("[^\n]*\n|[^\n]+", text)


@pytest.mark.parametrize("unit,run,batch", [("char", 1 << 20, 4 << 20), ("char", 64, 500), ("line", 1 << 20, 4 << 20), ("line", 64, 500)])
def test_fim_pieces(monkeypatch, unit, run, batch):
    monkeypatch.setattr(fim, "RUN", run)
    monkeypatch.setattr(fim, "BATCH", batch)
    rng = random.Random(run)
    texts = ["", "a", "Ünï\n", "\n\n", "𝄞" * 50, "", "x" * 700, "line\n" * 200, "no end\nof line", ""] + ["".join(rng.choice("ab\nü𝄞 ") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    cuts = [sorted(rng.randint(0, len(units_of(t, unit))) for _ in range(2)) for t in texts]
    for lo, count in ((0, len(texts)), (3, 30), (0, 1), (9, 1)):
        for first, n in fim._slices(pa.array(texts).slice(lo, count)):
            part, own = pa.array(texts).slice(lo + first, n), range(lo + first, lo + first + n)
            got = fim.pieces(part, np.array([cuts[i][0] for i in own]), np.array([cuts[i][1] for i in own]), unit)
            for k, i in enumerate(own):
                u, (a, b) = units_of(texts[i], unit), cuts[i]
                assert [p[k].as_py() for p in got] == ["".join(u[:a]), "".join(u[a:b]), "".join(u[b:])]


@pytest.mark.parametrize("unit", ["char", "line"])
def test_fim_round_trip(spark, unit):
    long = "Lorem ünï 𝄞\n" * 200_000
    texts = [None, "", "a", "<P>", "x<S>y", "a <M", "P>", "𝄞\nü", long, long, "no <p> marker\n" * 9]
    rows = [(i, t, "x") for i, t in enumerate(texts * 6)] + [(None, "null id", "x"), (3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    out = fim.transform(docs, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    by = {}
    for d, t, _ in rows:
        by.setdefault(d, []).append((*brute_fim(d, t or "", units_of(t or "", unit)), t or ""))
    for r in out:
        assert tuple(r)[1:] in by[r["doc_id"]]
    assert len(out) == len(rows) and {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fim_of_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in table(spark, sf, "documents").collect():
        n, form, a, b, out = brute_fim(r["doc_id"], r["text"] or "", list(r["text"] or ""))
        want[r["doc_id"]] = (n, form, a, b, sha(out), sha(r["text"] or ""))
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op13_fill_in_middle(spark, sf).collect()} == want
