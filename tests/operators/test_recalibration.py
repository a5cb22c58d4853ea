from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gapline.functions import cigar as C
from gapline.operators.consensus import anchor_consensus, anchor_consensus_table, pileup_columns, recalibrate


def pairs_of(cigar, pos):
    q, r, out = 0, pos, []
    for n, o in re.findall(r"(\d+)([MID])", cigar):
        for _ in range(int(n)):
            out.append((q if o in "MI" else -1, r if o in "MD" else -1))
            q, r = q + (o in "MI"), r + (o in "MD")
    return out


def observed(pairs, seq, s, e, base):
    """What one read says about the run from s to e, both included; None if it does not cover it."""
    place = {r: i for i, (_, r) in enumerate(pairs) if r >= 0}
    if s not in place or e not in place:
        return None
    i, j = place[s], place[e]
    if s == e and pairs[i][0] < 0:
        return "", 0
    if pairs[i][0] >= 0:
        near = next((pairs[k] for k in range(i - 1, -1, -1) if min(pairs[k]) >= 0), None)
        a = near[0] + 1 if near else pairs[i][0]
    else:
        near = next((pairs[k] for k in range(i + 1, len(pairs)) if min(pairs[k]) >= 0), None)
        if near is None or near[1] > e:
            return None
        a = near[0]
    if pairs[j][0] >= 0:
        near = next((pairs[k] for k in range(j + 1, len(pairs)) if min(pairs[k]) >= 0), None)
        b = near[0] if near else pairs[j][0] + 1
    else:
        near = next((pairs[k] for k in range(j - 1, -1, -1) if min(pairs[k]) >= 0), None)
        if near is None or near[1] < s:
            return None
        b = near[0] + 1
    if b < a:
        return None
    extra = int(b - a == e - s + 1 and a > 0 and seq[a - 1] == base)
    return seq[a:b], b - a + extra


def brute(seq, reads):
    out, skip = [], False
    for m in re.finditer("A+|C+|G+|T+|N+", seq):
        s, e, base = m.start(), m.end() - 1, m[0][0]
        seen = [x for p, r in reads if (x := observed(p, r, s, e, base)) is not None]
        if len(m[0]) > 20 or not seen:
            out.append(m[0])
            continue
        if skip:
            out.append(m[0])
            skip = False
            continue
        counts = Counter(n for _, n in seen)
        own = counts.pop(len(m[0]), 0)
        best = max(counts.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
        size = best[0] if best[1] > own else len(m[0])
        fit = [t for t, _ in seen if len(t) == size]
        if size == 0:
            skip = True
            continue
        if not fit:
            out.append(m[0])
            continue
        new = ""
        for column in zip(*fit, strict=True):
            votes = Counter(column)
            top = max(votes.values())
            new += base if votes[base] == top else min(b for b, n in votes.items() if n == top)
        out.append(new)
        skip = size != len(m[0])
    return "".join(out)


def test_recalibration_equals_a_loop(spark):
    rng = random.Random(4)
    contigs, reads, rows = [], [], {}
    for c in range(12):
        seq = "".join(rng.choice("ACGT") * rng.choice([1, 1, 1, 2, 3, 5, 8, 22]) for _ in range(12))
        contigs.append((c, seq))
        rows[c] = []
        for k in range(rng.randint(0, 6)):
            start = rng.randint(0, 3)
            ops, at, read = [], start, ""
            while at < len(seq):
                n = rng.randint(1, 9)
                kind = rng.choice("MMMID")
                if kind == "M":
                    n = min(n, len(seq) - at)
                    read += "".join(b if rng.random() < 0.95 else rng.choice("ACGT") for b in seq[at : at + n])
                    at += n
                elif kind == "D":
                    n = min(rng.randint(1, 2), len(seq) - at)
                    at += n
                else:
                    n = rng.randint(1, 2)
                    read += seq[at] * n
                ops.append(f"{n}{kind}")
            cigar = "".join(ops)
            reads.append((c, f"{c}/{k}", start, cigar, read))
            rows[c].append((pairs_of(cigar, start), read))
    df = spark.createDataFrame(reads, "contig int, read_id string, pos int, cigar string, seq string")
    pairs = df.select("contig", "read_id", F.posexplode(C.aligned_pairs(C.parse(F.col("cigar")), F.col("pos"))).alias("ordinal", "p")).select("contig", "read_id", "ordinal", "p.*")
    got = {r.contig: r.seq for r in recalibrate(spark.createDataFrame(contigs, "contig int, seq string"), df, pairs).collect()}
    assert got == {c: brute(s, rows[c]) for c, s in contigs}


def test_pileup_columns(spark):
    df = spark.createDataFrame([("r", 5, "2M2I1D1M", "ACGGT")], "qname string, pos int, cigar string, seq string")
    rows = pileup_columns(df, key=["qname"], ops=C.parse(F.col("cigar"))).orderBy("ref").collect()
    assert [(r.ref, r.base, r.inserted) for r in rows] == [(5, "A", ""), (6, "C", "GG"), (7, "", ""), (8, "T", "")]


def test_anchor_consensus(spark):
    end = "T" * 15
    same = ["ACGTACGT" + end] * 3
    assert anchor_consensus(same) == "ACGTACGT"
    assert anchor_consensus([]) == "" and anchor_consensus(["ACGT"]) == ""
    # a base that one of three rows lacks, an insertion of one row, a substitution
    assert anchor_consensus(["ACGTACGT" + end, "ACGTACGT" + end, "AC-TACGT" + end]) == "ACGTACGT"
    assert anchor_consensus(["AC-GTACGT" + end, "AC-GTACGT" + end, "ACTGTACGT" + end]) == "ACGTACGT"
    assert anchor_consensus(["ACGTAAGT" + end, "ACGTACGT" + end, "ACGTACGT" + end]) == "ACGTACGT"
    # two rows share a two-base insertion: columns tie with gaps, the stretch decides
    rows = ["ACG--TAC" + end, "ACGGGTAC" + end, "ACGGGTAC" + end, "ACG--TAC" + end, "ACGGGTAC" + end]
    assert anchor_consensus(rows) == "ACGGGTAC"
    df = spark.createDataFrame([(1, r) for r in rows] + [(2, same[0])], "cluster_id int, aligned string")
    assert {r.cluster_id: r.consensus for r in anchor_consensus_table(df).collect()} == {1: "ACGGGTAC", 2: "ACGTACGT"}
