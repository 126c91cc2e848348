"""Each operator against plain Python, with nulls, ties, repeated rows, long and empty texts and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from notelake.llm import common, components, fingerprints, lm_scoring, near_dup, packing, piece_encoding, quality, sharding, suffix_dedup, suffix_groups, tool_calls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, label string, id string, key int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en" if t else None, "s" if k % 3 else None, len(t or ""), 7, "x", "y", 9) for k, (i, t) in enumerate(rows)], SCHEMA)


def prose(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "éta", "the", "of"]) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    base = prose(r, 300)
    near = base.split()
    near[150] = "changed"
    out = [(i, prose(r, r.randrange(5, 200))) for i in range(30)]
    return out + [(40, base), (41, " ".join(near)), (42, base), (43, base), (50, ""), (51, None), (52, "  \n\t "), (53, "one two"), (54, "one two"), (55, "x" * 30000), (56, prose(r, 9000)), (56, "same id, other text"), (57, "twin row"), (57, "twin row"), (None, "no id " * 40)]


def test_suffix_array():
    r = random.Random(3)
    for _ in range(500):
        t = [r.randrange(r.choice([1, 2, 4])) for _ in range(r.randrange(40))]
        assert suffix_groups.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_fingerprints(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op1_weighted_sampling(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda x: (-(x[0] if x[0] is not None else -(1 << 63)), x[1] or ""))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()] += 1
    assert collections.Counter((g.doc_id, g.n_chars, g.edited_sha256) for g in got) == want
    assert len({g.fingerprint for g in got if g.doc_id in (40, 42, 43)}) == 1
    by = {g.doc_id: g for g in got}
    assert by[43].near_next == 1.0 and by[42].near_next > 0.8 and 0 <= by[1].near_next < 0.6


def test_near_duplicates(spark, rows):
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table(spark, rows)).collect()}
    assert {got[i] for i in (40, 41, 42, 43)} == {40} and got[53] == got[54] == 53
    assert got[1] == 1 and got[50] == got[51] == 50 and got[52] == 52 and got[57] == 57
    assert near_dup.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_near_duplicates_within_shared_passages(spark):
    """Texts that share most of a passage meet in large buckets; classes equal those of all pairs."""
    r = random.Random(11)
    shared, docs = prose(r, 60), []
    for k in range(60):
        own = (shared + " " + prose(r, r.choice([6, 9, 12, 15]))).split()
        docs.append((len(docs), " ".join(own)))
        for _ in range(r.randrange(3)):
            own[r.randrange(50, len(own))] = f"w{k}"
            docs.append((len(docs), " ".join(own)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    want = list(range(len(docs)))
    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((want[a], want[b]))
                want = [low if c == high else c for c in want]
    got = {g.doc_id: g.class_id for g in near_dup.near_duplicates(table(spark, docs)).collect()}
    assert 1 < len(set(want)) < len(docs) and got == dict(enumerate(want))


def repeats(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(b), sum(gone), sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram", "held", "hot"), [(100, 48, 1 << 20, 20_000), (12, 4, 1 << 20, 20_000), (12, 4, 200, 20_000), (12, 4, 1 << 20, 2)])
def test_repeated_strings(spark, rows, length, gram, held, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_BYTES", held)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    docs = [(i, t) for i, t in rows if i is not None and i < 56]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(table(spark, docs), length, gram).collect()}
    assert got == repeats(docs, length)


def test_repeated_strings_of_repeated_rows(spark):
    text = prose(random.Random(2), 60)
    got = sorted(r.n_removed for r in suffix_dedup.remove_repeats(table(spark, [(1, text), (1, text), (None, text)])).collect())
    assert got == [0, len(text.encode()), len(text.encode())]
    assert suffix_dedup.remove_repeats(table(spark, [(1, "a")]).limit(0)).count() == 0


def test_repeated_strings_of_null_ids(spark):
    """Different texts without id are never taken for copies; equal ones are."""
    r = random.Random(7)
    texts = [" ".join(f"n{k}x{r.randrange(10**9)}" for _ in range(9)) for k in range(3000)]
    got = suffix_dedup.remove_repeats(table(spark, [(None, t) for t in texts] + [(None, texts[0])])).collect()
    assert sorted(g.n_removed for g in got)[-2:] == [0, len(texts[0])] and len(got) == 3001


def test_piece_encoding(spark, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m, r = sentencepiece.SentencePieceProcessor(model_file=path), piece_encoding.PieceModel(path), random.Random(5)
    for _ in range(2000):
        t = "".join(r.choice(r.choice(["a b the ing ", "é日😀①x ▁", " ", "\n\t_-0"])) for _ in range(r.randrange(40)))
        assert m.encode(t) == sp.encode(t) + [2]
        assert m.decode(m.encode(t)) == sp.decode(sp.encode(t) + [2])
    got = collections.Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in piece_encoding.encode_documents(table(spark, rows), path).collect())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, sp.encode(t or "") + [2]) for i, t in rows]
    assert got == collections.Counter((i, len(x), digest(" ".join(map(str, x))), digest(sp.decode(x))) for i, x in ids)


def test_piece_decoding_starts_from_ids(spark, rows, monkeypatch):
    """ids and decoded texts are results, in whatever parts they are handed over; ids that no encoding gives decode as the library's do."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m, r = sentencepiece.SentencePieceProcessor(model_file=path), piece_encoding.PieceModel(path), random.Random(6)
    for _ in range(2000):
        ids = [r.choice([*m.byte, 1, 2, 2, r.randrange(3, sp.vocab_size()), m.byte[0xC3], m.byte[0xA9]]) for _ in range(r.randrange(12))]
        assert m.decode(ids) == sp.decode(ids)
    odd = [(k, t) for k, t in enumerate([" a", "  a", "\t\u2581x", "\ufffd", "é日😀①", "\n\n", "\u0000z", None])]
    want = [(i, [*sp.encode(t or ""), 2]) for i, t in rows + odd]
    for part in (1, 1 << 22):
        monkeypatch.setattr(piece_encoding, "HANDED", part)
        got = piece_encoding.encode_documents(table(spark, rows + odd), path, with_text=True).collect()
        assert collections.Counter((g.doc_id, tuple(g.ids), g.text) for g in got) == collections.Counter((i, tuple(x), sp.decode(x)) for i, x in want)


def counts(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality(spark, rows):
    r = random.Random(8)
    more = rows + [(100 + i, prose(r, r.randrange(50, 90)) + "\nline one\nline one\n") for i in range(300)] + [(900, " ".join(w + "###$$$" for w in prose(r, 80).split()))]
    stats = common.written(quality.measured(table(spark, more)))
    got = collections.Counter((x.doc_id, *(x[c] for c in quality.STATS)) for x in stats.collect())
    assert got == collections.Counter((i, *counts(t)) for i, t in more)
    kept = {x.doc_id: x.kept for x in quality.judged(stats).collect()}
    assert not kept[900] and not kept[51] and all(kept[100 + i] for i in range(300))
    empty = common.written(quality.measured(table(spark, rows).limit(0)))
    assert quality.judged(empty).count() == 0


def brute_distances(x, seed):
    """Distances by the least determinant of covariance of exact halves, over many random starts, reweighted; in units of the cutoff."""
    rng, steps = np.random.default_rng(seed), quality.smallest_steps(np.median(x, 0))
    floor, h, best = np.diag(steps**2), len(x) // 2 + 1, None
    distances = lambda c, s: np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s), x - c)
    for _ in range(60):
        half, last = rng.choice(len(x), 6, replace=False), np.inf
        while True:
            c, s = x[half].mean(0), np.cov(x[half].T, bias=True)
            det = np.linalg.slogdet(s + floor)[1]
            if len(half) == h and det > last - 1e-9:
                break
            last = det if len(half) == h else np.inf
            half = np.argsort(distances(c, s + floor), kind="stable")[:h]
        if best is None or det < best[0]:
            best = det, c, s
    det, c, s = best
    dof = max(int((np.diag(s) > steps**2).sum()), 1)
    d = distances(c, s + floor)
    near = d <= np.sort(d)[h - 1] / quality.chi_square_quantile(0.5, dof) * quality.chi_square_quantile(0.025, dof)
    d = distances(x[near].mean(0), np.cov(x[near].T, bias=True) + floor)
    return d / max(np.sort(d)[h - 1] / quality.chi_square_quantile(0.5, dof), 1) / quality.chi_square_quantile(quality.TAIL, dof)


def test_quality_against_brute_force(spark):
    """Distances of two groups equal those of exact halves but for the width of bins; junk of graded strength goes."""
    r, docs = random.Random(31), []
    for k in range(700):
        w = prose(r, int(min(r.lognormvariate(4.5, 0.6), 900)) + 12).split()
        w[3] += "$" if k % 5 == 0 else ""
        docs.append((k, " ".join(w), "en", "a" if k % 3 else "b"))
    docs += [(1000 + k, " ".join(w + "#$" * (1 + k % 4) if i % (1 + k % 7) == 0 else w for i, w in enumerate(prose(r, 120).split())), "en", "a") for k in range(90)]
    stats = common.written(quality.measured(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")))
    got = {g.doc_id: g for g in quality.judged(stats).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for source in "ab":
        ids = [g.doc_id for g in got.values() if g.source == source and not g.base_failed]
        n, chars, symbols, lines, words = np.array([[got[i][c] for c in names] for i in ids], dtype=float).T
        want = brute_distances(np.stack([np.log1p(n), np.log(chars / n), np.log1p(100 * symbols / chars), np.log1p(lines), words / n], 1), 5)
        have = np.array([got[i].distance for i in ids])
        # bins are a sixteenth of a doubling wide, and steps end short of the last percent: other halves, much the same estimate
        assert np.corrcoef(np.log(have), np.log(want))[0, 1] > 0.98 and abs(np.median(have / want) - 1) < 0.1
        assert ((have > 1) == (want > 1)).mean() > 0.99
    assert not any(got[1000 + k].kept for k in range(90)) and sum(got[k].kept for k in range(700)) >= 690


def test_chi_square_quantiles():
    for dof, tail, want in ((1, 0.5, 0.454936), (2, 0.025, 7.377759), (3, 0.05, 7.814728), (4, 0.5, 3.356694), (5, 0.01, 15.086272)):
        assert abs(quality.chi_square_quantile(tail, dof) - want) < 1e-5


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    r = random.Random(4)
    histogram = [(n, r.randrange(1, 9)) for n in range(1, 65)]
    cap = packing.Capacity(tokens=64, documents=5, attention=2200 * 2, rule=rule)
    bins = collections.defaultdict(list)
    for length, first, end, per, start, offset in packing.best_fit(histogram, cap):
        for rank in range(first, end):
            at = rank - first
            bins[start + at // per].append((offset + at % per * length, length))
    assert sum(map(len, bins.values())) == sum(n for _, n in histogram)
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.concatenate([[0], np.cumsum([n for _, n in parts])])[:-1].tolist()
        assert sum(n for _, n in parts) <= 64 and len(parts) <= 5 and sum(n * n for _, n in parts) <= 4400


@pytest.mark.parametrize("documents", [3, 5, 64])
def test_best_fit_chooses_as_piece_by_piece(documents):
    """Runs of classes fill sequences as single pieces do, each in the sequence with the least weighted norm left."""
    r = random.Random(documents)
    histogram = [(n, r.randrange(1, 7)) for n in range(1, 49)]
    cap = packing.Capacity(tokens=64, documents=documents, attention=1800 if documents > 3 else 4096)
    histogram = [(n, c) for n, c in histogram if n * n <= cap.attention]
    bins = collections.defaultdict(list)
    for length, first, end, per, start, _ in packing.best_fit(histogram, cap):
        for rank in range(first, end):
            bins[start + (rank - first) // per].append(length)
    limit, left, held = np.array([64, documents, cap.attention], dtype=float), [], []
    for length, count in sorted(histogram, reverse=True):
        for _ in range(count):
            need = np.array([length, 1, length * length])
            fits = [k for k, x in enumerate(left) if (x >= need).all()]
            if fits:
                k = min(fits, key=lambda k: ((((left[k] - need) / limit) ** 2 * cap.weights).sum(), k))
            else:
                k = len(left)
                left.append(limit.copy())
                held.append([])
            left[k] -= need
            held[k].append(length)
    assert sorted(map(sorted, bins.values())) == sorted(map(sorted, held))


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    assert packing.WordIds(path).separates and not packing.WordIds(public_tokenizers.path("byte_bpe_50k.json")).separates
    got = packing.pack_documents(table(spark, rows), path).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert collections.Counter(tuple(g)[:5] for g in got) == want
    for s in {g.sequence_id for g in got}:
        at = 0
        for g in sorted((g for g in got if g.sequence_id == s), key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= 4096


def test_sharding(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op8_stratified_interleaving(spark, str(tmp_path)).collect()
    assert collections.Counter((g.doc_id, g.size, g.text_crc32) for g in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = []
    for s in range(8):
        slots = sorted(g.slot for g in got if g.shard == s)
        assert slots == list(range(len(slots)))
        sizes.append(len(slots))
        for source in ("s", None):
            assert abs(sum(g.source == source and g.shard == s for g in got) - sum(g.source == source for g in got) / 8) <= 1
    assert max(sizes) - min(sizes) <= 1


def test_scores_tell_the_target(spark):
    r = random.Random(6)
    ours, theirs = (lambda: " ".join(r.choice("red green blue teal".split()) for _ in range(40))), (lambda: " ".join(r.choice("one two three four".split()) for _ in range(40)))
    docs = [(i, ours() if i % 2 else theirs()) for i in range(80)] + [(90, None), (None, "red blue")]
    target = spark.createDataFrame([(i,) for i in range(1, 40, 2)], "doc_id long")
    got = {x.doc_id: x for x in lm_scoring.score(table(spark, docs), target).collect()}
    held = [got[i].score for i in range(41, 80, 2)], [got[i].score for i in range(40, 80, 2)]
    assert max(held[0]) < min(held[1]) and got[90].score is None and got[None].n_words == 2
    assert lm_scoring.score(table(spark, docs).limit(0), target).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame([(1, 5, "a", "lookup", '{"query":"q","limit":3}', ["b"]), (1, 9, "b", "lookup", '{"query":"q","limit":"3"}', []), (1, 2, "c", "nope", None, ["d"]), (1, 3, "d", "reply", "{", ["c"]), (2, 0, "a", "reply", '{"query":"é"}', None)], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, 6, "a", "r1"), (1, 7, "a", "r2"), (1, 8, "z", "lost"), (None, 1, "a", "x")], "conv_id long, turn long, call_id string, content string")
    got = {(g.conv_id, g.call_id): g for g in tool_calls.link(calls, results, tool_calls.TOOLS).collect()}
    assert got[1, "b"].level < got[1, "a"].level and got[1, "c"].level is None and got[1, "d"].level is None
    assert (got[1, "a"].status, got[1, "a"].n_results, got[1, "z"].status, got[2, "a"].status) == ("linked", 2, "orphan", "unanswered")
    assert (got[1, "b"].error, got[1, "c"].error, got[1, "d"].error, got[1, "a"].error) == ("limit: not of type integer", "unknown tool", "not JSON", None)
    assert got[2, "a"].canonical_json == '{"arguments":{"query":"é"},"depends_on":[],"id":"a","name":"reply","result":null,"type":"tool_call","valid":true}'


def test_tool_calls_without_identifier_stay_apart(spark):
    calls = spark.createDataFrame([(1, 1, None, "reply", '{"query":"a"}', []), (1, 2, None, "lookup", '{"a":NaN}', ["k"]), (1, 3, "k", "reply", '{"query":"\\ud800"}', None), (None, 1, "k", "reply", "{}", None), (None, 1, "k", "reply", "{}", None)], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, 4, None, "x"), (1, 5, None, "x"), (None, 1, "k", "y")], "conv_id long, turn long, call_id string, content string")
    got = tool_calls.link(calls, results, tool_calls.TOOLS).collect()
    assert collections.Counter(g.status for g in got) == {"unanswered": 5, "orphan": 3}
    by = {g.call_turn: g for g in got if g.conv_id == 1 and g.call_turn}
    assert by[2].error == "not JSON" and by[2].level == 1 and by[3].level == 0 and "\\ud800" in by[3].canonical_json


def test_tool_call_levels(spark):
    """Levels are longest chains of dependences in trees, in graphs and beside cycles."""
    r, rows = random.Random(3), []
    for conv in range(30):
        n = r.randrange(1, 25)
        for i in range(n):
            rows.append((conv, f"c{i}", [f"c{r.randrange(n if conv % 3 == 2 else max(i, 1))}" for _ in range(r.randrange(2 if conv % 3 else 4))] if i or conv % 3 == 2 else []))
    rows += [(99, f"c{i}", [f"c{i + 1}"]) for i in range(200)]
    needs = {(c, i): {d for d in deps if (c, d) in {(x, y) for x, y, _ in rows}} for c, i, deps in rows}
    want = {}
    while ready := [k for k, ds in needs.items() if k not in want and all((k[0], d) in want for d in ds)]:
        want |= {k: max([want[k[0], d] + 1 for d in needs[k]], default=0) for k in ready}
    got = {(g.conv_id, g.id): g.level for g in tool_calls.levels(spark.createDataFrame(rows, "conv_id long, id string, depends_on array<string>")).collect()}
    assert got == {k: want.get(k) for k in needs} and None in got.values()


def test_tool_call_query_keeps_every_turn(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a\nb"), (1, 2, "assistant", "r"), (1, 3, "user", "c"), (1, 4, None, None), (2, 0, "assistant", None), (None, 1, "user", "x"), (None, 2, "assistant", "y")]
    spark.createDataFrame([(*x, 1, "e") for x in rows], "conv_id long, turn long, role string, text string, position int, error string").write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = tool_calls.op2_tool_call_linking(spark, f"{tmp_path}/a").collect()
    assert collections.Counter((g.conv_id, g.status) for g in got) == {(1, "other"): 2, (1, "linked"): 1, (1, "unanswered"): 1, (2, "orphan"): 1, (None, "unanswered"): 1, (None, "orphan"): 1}
    assert {g.call_id: g.level for g in got if g.conv_id == 1 and g.call_id} == {"call-1": 1, "call-3": 0}
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert tool_calls.op2_tool_call_linking(spark, f"{tmp_path}/b").count() == 0


def test_archives(spark, tmp_path):
    big = "<p>é</p>" * 300
    pages = [(1, "http://a/x y", big), (2, "http://b", big), (3, None, None), (4, "http://c", "small"), (5, "http://d", "small"), (2, "http://b", big), (None, "u", "n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for version in (1, 2):
        arc = warc.pages_to_arc(df, f"{tmp_path}/arc{version}", version)
        back = warc.read_warc(spark, warc.convert(spark, arc, f"{tmp_path}/warc{version}")).collect()
        assert collections.Counter((b.key, b.payload_bytes, b.payload_digest) for b in back) == collections.Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in pages)
        kinds = collections.Counter((b.key, b.record_type) for b in back)
        assert kinds[1, "revisit"] == 1 and kinds[2, "response"] == 1 and kinds[2, "revisit"] == 1 and kinds[4, "response"] == kinds[5, "response"] == 1
    found = list(warc.arc_records(b"filedesc://x 0.0.0.0 1996 text/plain 5\njunk\n\nhttp://a b 1.2.3.4 199601010000 text/html 4\nbody\nhttp://c 1.2.3.4 19960101000000 text/html 40\ncut"))
    assert [(f[1], f[5], f[6]) for f in found] == [("http://a b", b"body", False), ("http://c", b"cut", True)]


def test_equal_payloads_stay_in_their_archives(spark, tmp_path, monkeypatch):
    """Half of the records have one payload: they are linked across archives, and no payload is shuffled or meets its like."""
    big, n = "z" * 1200, 240
    pages = spark.range(n).repartition(6).selectExpr("id AS page_id", "concat('http://h/', id) AS url", f"IF(id % 2 = 0, '{big}', concat(id, repeat('q', 1100))) AS html")
    arc, plans, write = warc.pages_to_arc(pages, f"{tmp_path}/arc"), [], warc.write_archives

    def seen(archives, path):
        plans.append(archives._jdf.queryExecution().analyzed().toString())
        return write(archives, path)

    monkeypatch.setattr(warc, "write_archives", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = warc.read_warc(spark, warc.convert(spark, arc, f"{tmp_path}/warc")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(plans) == 1 and "block" not in plans[0]
    last = next(b.record_id for b in back if b.key == n - 2)
    assert {(b.key, b.record_type, b.refers_to_id) for b in back} == {(i, "revisit", last) if i % 2 == 0 and i != n - 2 else (i, "response", None) for i in range(n)}
    assert all(b.payload_bytes == (1200 if b.key % 2 == 0 else 1100 + len(str(b.key))) for b in back) and len(back) == n
    assert warc.headers(b"HTTP/1.1 200 OK\r\nX-Page-Id:\t7\r\nx-page-id: 8\r\nno colon\r\nUrl: http://a:1\r\n\r\n") == {"x-page-id": "7", "url": "http://a:1"}


def test_archives_keep_keys_of_all_sizes(spark, tmp_path):
    """The largest page_id answers whatever its digits; the query has the contract's five columns, empty tables too."""
    big, ids = "y" * 1500, [7, 10**18 + 5, -(1 << 63), (1 << 63) - 1]
    spark.createDataFrame([(i, "u", big, 1) for i in ids], "page_id long, url string, html string, key int").write.parquet(f"{tmp_path}/a/pages.parquet")
    got = warc.op10_legacy_archive_converter(spark, f"{tmp_path}/a")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert {(g.page_id, g.record_type, g.refers_to) for g in got.collect()} == {(i, "revisit", ids[3]) for i in ids[:3]} | {(ids[3], "response", None)}
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert warc.op10_legacy_archive_converter(spark, f"{tmp_path}/b").count() == 0


def test_pipeline_keeps_clean_documents(spark, rows, tmp_path):
    import corpus_pipeline

    docs = [(i, t) for i, t in rows if i is not None and t and len(t) > 200]
    table(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i, t in docs if i < 30 and counts(t)[0] >= 10}
    assert clean <= got and 40 in got and not got & {41, 42, 43}


def test_pipeline_stages(spark, rows, tmp_path):
    """Each stage on nulls, empty, long and repeated texts, repeated and null ids, clashing columns and an empty table."""
    import corpus_pipeline

    docs = common.written(table(spark, rows))
    assert not any(stage(spark, docs.limit(0), "").collect() for _, stage in corpus_pipeline.STAGES)
    kept = {name: stage(spark, docs, "") for name, stage in corpus_pipeline.STAGES}
    assert all(tuple(kept[name].columns) == corpus_pipeline.COLUMNS for name, _ in corpus_pipeline.STAGES[:-1])
    kept = {name: df.collect() for name, df in kept.items()}
    first = [(g.doc_id, g.text) for g in kept["near-duplicates"]]
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    want, seen = [], set()
    for i, t in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], digest(x[1]))):
        if (t or "") not in seen and i != 41:  # 41 is near 40, with a lesser id or digest
            want.append((i, t or ""))
        seen.add(t or "")
    assert sorted((str(i), t or "") for i, t in first) == sorted((str(i), t) for i, t in want)
    assert {g.doc_id for g in kept["quality rules"]} >= {i for i, t in rows if i is not None and i < 30 and counts(t)[0] >= 10}
    assert len(kept["repeated strings"]) == len(rows) and all(g.n_chars == len(g.text) for g in kept["repeated strings"])
    assert sum(len((t or "")) for _, t in rows) > sum(g.n_chars for g in kept["repeated strings"])


@pytest.mark.parametrize("name", ["op1_weighted_sampling", "op3_probminhash", "op4_suffix_groups", "op5_prefix_table_encoding", "op6_robust_outliers", "op7_vector_best_fit", "op8_stratified_interleaving", "op9_cross_entropy_difference", "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    from notelake.llm import queries

    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_scores_count_every_word_and_pair(spark, monkeypatch):
    """Losses equal those of whole counts, with more distinct words and pairs than any fixed table of classes tells apart."""
    monkeypatch.setattr(lm_scoring, "BLOCK", 1 << 16)
    monkeypatch.setattr(lm_scoring, "PART", 1 << 18)
    r = random.Random(12)
    docs = [(i, " ".join(f"w{r.choice([int(r.paretovariate(0.5)) % 1000, r.randrange(10**6)])}" for _ in range(1000))) for i in range(200)] + [(300, ""), (301, None), (None, "w1 w2 lone"), (302, "w1"), (302, "w1 w2 w1")]
    sides = [i is not None and i % 3 == 0 for i, _ in docs]
    words, pairs = ([collections.Counter(), collections.Counter()] for _ in range(2))
    for side, (_, t) in zip(sides, docs, strict=True):
        w = WORD.findall(t or "")
        words[side].update(w)
        words[side].update([None] if w else [])
        pairs[side].update(zip([None, *w], w, strict=False))
    totals = [sum(n for w, n in c.items() if w is not None) for c in words]
    size = len(set(words[0]) | set(words[1])) - 1
    assert size > 65536

    def loss(t, side, ours):
        """A document's loss by a side's counts, without its own where it is of that side."""
        w, k = WORD.findall(t or ""), totals[1] / totals[side]
        own, twos = (collections.Counter([None, *w]), collections.Counter(zip([None, *w], w, strict=False))) if ours == side else ({}, {})
        single, both = (lambda a: k * (words[side][a] - own.get(a, 0))), (lambda a, b: k * (pairs[side][a, b] - twos.get((a, b), 0)))
        total = k * (totals[side] - len(w) * (ours == side))
        return sum(-np.log2((both(a, b) + 20 * (single(b) + 0.5) / (total + 0.5 * size)) / (single(a) + 20)) for a, b in zip([None, *w], w, strict=False)) / len(w)

    target = spark.createDataFrame([(i,) for s, (i, _) in zip(sides, docs, strict=True) if s] + [(None,), (10**9,)], "doc_id long")
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_words, x.target_loss, x.background_loss) for x in lm_scoring.score(table(spark, docs), target).where("n_words > 0").collect())
    want = sorted((i if i is not None else -1, len(WORD.findall(t)), loss(t, 1, s), loss(t, 0, s)) for s, (i, t) in zip(sides, docs, strict=True) if t)
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-9)


def test_near_duplicates_with_repeated_lines(spark):
    """Sets alike, counts not: a line that occurs 50 times is changed, or repeated another number of times; classes equal those of all pairs."""
    r = random.Random(21)
    docs = []
    for k in range(12):
        base, line = prose(r, 200), f"printed on page {k} of the long report"
        other = line.replace(f"page {k}", f"page x{k}")
        docs += [base + (" " + line) * 50, base + (" " + other) * 50, base + (" " + line) * 3, prose(r, 60) + (" " + line) * 50]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, docs)]
    want = list(range(len(docs)))
    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((want[a], want[b]))
                want = [low if c == high else c for c in want]
    got = {g.doc_id: g.class_id for g in near_dup.near_duplicates(table(spark, list(enumerate(docs)))).collect()}
    assert len(set(want)) == 24 and got == dict(enumerate(want))


def test_small_tables_have_few_files(spark, tmp_path):
    """However many partitions a shuffle has, a small class table's steps aren't written by so many tasks."""
    import glob

    r, conf = random.Random(3), {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    links = spark.createDataFrame([(k, k + 1 + r.randrange(3)) for k in range(0, 3000, 4)], "a long, b long")
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        label = components.components(links)
        files = label.inputFiles()
        wide = common.written(common.few(spark.range(1000).repartition(64, "id"), common.ROWS_A_FILE * 64))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < len(files) <= common.FEWEST and len(wide.inputFiles()) == 64
    assert sorted(g.id for g in label.collect() if g.id == g.label) == list(range(0, 3000, 4))


def test_memos_go_with_the_operator():
    """What a worker remembers of one operator is gone when another's tasks come, and stays for its own."""
    import pyarrow as pa

    first = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    assert first["alpha"] and packing.word_ids(public_tokenizers.path("word_bpe_49k.json")) is first
    list(quality._stats(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})])))
    assert not common._KEPT and "alpha" not in packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    common.forget()


def test_components_of_long_chains(spark, monkeypatch):
    """A chain whose least id stands at one end and whose others descend, and a random one, in few rounds."""
    rounds, written = [], components.written
    monkeypatch.setattr(components, "written", lambda df, what: rounds.append(what) or written(df, what))
    order = random.Random(9).sample(range(1000, 1400), 400)
    chains = [0, *range(99, 0, -1)], order
    got = {x.id: x.label for x in components.components(spark.createDataFrame([p for c in chains for p in zip(c, c[1:], strict=False)], "a long, b long")).collect()}
    assert got == {i: min(c) for c in chains for i in c} and len(rounds) < 20
