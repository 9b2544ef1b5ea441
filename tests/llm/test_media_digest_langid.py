import cmath
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import digest, langid, media, queries


def test_media_round_trip(odd, odd_rows, none):
    rows = media.features(odd, media=True).collect()
    assert len(rows) == len(odd_rows)
    want = sorted(hashlib.sha256(media.payload((r[1] or "").encode())).hexdigest() for r in odd_rows)
    assert sorted(r.payload_sha256 for r in rows) == want
    for r in rows:
        back = media.from_wav(bytes(r.media))
        assert len(back) == r.payload_bytes and len(back) % 64 == 0 and zlib.crc32(back[-64:]) == r.tail_crc32
        assert hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
        assert [(p.frame, p.pair) for p in r.pairs] == [tuple(x) for x in media.fingerprint(back).tolist()]
    assert media.features(none).count() == 0


def test_media_slices_do_not_matter(monkeypatch):
    data = bytes(np.random.default_rng(0).integers(0, 256, 20_000, dtype=np.uint8))
    whole = media.fingerprint(data)
    monkeypatch.setattr(media, "SLICE", 7)
    assert np.array_equal(whole, media.fingerprint(data))


def brute_fingerprint(samples):
    """Plain sums for the transform, loops for peaks and pairs."""
    x = [float(v) - 128 for v in samples] + [0.0] * max(0, media.FRAME - len(samples))
    n, hop = media.FRAME, media.HOP
    frames = 1 + max(0, -(-(len(x) - n) // hop))
    x += [0.0] * ((frames - 1) * hop + n - len(x))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]
    peaks = []
    for f in range(frames):
        part = [a * w for a, w in zip(x[f * hop : f * hop + n], window)]
        spectrum = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / n) for i, v in enumerate(part))) for k in range(n // 2 + 1)]
        width = (n // 2 - 1) // media.BANDS
        best = []
        for b in range(media.BANDS):
            top = [(spectrum[k], -k) for k in range(1 + b * width, 1 + (b + 1) * width) if spectrum[k] > spectrum[k - 1] and spectrum[k] >= spectrum[k + 1] and spectrum[k] > 1e-3]
            best.append(-max(top)[1] if top else -1)
        peaks.append(best)
    out = []
    for f, p in enumerate(peaks):
        pairs = [(p[b], p[b + 1], 0) for b in range(media.BANDS - 1)]
        pairs += [(p[b], peaks[f + g][b], g) for g in range(1, media.REACH + 1) if f + g < frames for b in range(media.BANDS)]
        out += sorted((f, (a << 12) | (c << 4) | g) for a, c, g in pairs if a >= 0 and c >= 0)
    return out


def test_pairs_match_brute_force():
    rng = np.random.default_rng(1)
    for size in (64, 640, 1024):
        data = bytes(rng.integers(0, 256, size, dtype=np.uint8))
        assert [tuple(r) for r in media.fingerprint(data).tolist()] == brute_fingerprint(data)


def test_tone_has_its_bin():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / 8000)).astype(np.uint8).tobytes()
    p = media.peaks(tone)
    band = 1000 * media.FRAME // 8000 // ((media.FRAME // 2 - 1) // media.BANDS)
    assert (np.abs(p[:, band] - 1000 * media.FRAME / 8000) <= 1).mean() > 0.95


def brute_features(data):
    """Plain loops: entropy by counting, the rarest of each span, windows as bytes in order of first place."""
    n, padded = len(data), data + bytes(digest.FEATURE)
    windows = [padded[i : i + digest.FEATURE] for i in range(n)]
    entropy = [-sum(c / digest.FEATURE * math.log2(c / digest.FEATURE) for c in Counter(w).values()) for w in windows]
    chosen = set()
    for at in range(max(1, n - digest.SPAN + 1)) if n else []:
        span = range(at, min(n, at + digest.SPAN))
        top = max(entropy[i] for i in span)
        chosen.add(next(i for i in span if entropy[i] > top - 1e-9))
    return list(dict.fromkeys(windows[i] for i in sorted(chosen)))


def test_features_match_brute_force(texts):
    """Where entropies that are equal in exact numbers are equal in the module's, the same windows are chosen."""
    some = ["", "a", "short one", "a" * 500, "ab" * 100, "Lorem ipsum " * 9] + [t[:700] for t in list(texts.values())[:25]]
    for t, got in zip(some, digest.features([t.encode() for t in some])):
        want = np.frombuffer(b"".join(brute_features(t.encode())), np.uint8)
        want = digest._hash(want, np.arange(0, len(want), digest.FEATURE)) if len(want) else np.zeros(0, np.uint64)
        assert got.tolist() == want.tolist(), t


def brute_likeness(a, b):
    """Chains of sets of bits of the features."""
    def chained(features):
        out = []
        for at in range(0, len(features), digest.CAPACITY):
            out.append({int(h) >> 11 * k & digest.BITS - 1 for h in features[at : at + digest.CAPACITY] for k in range(digest.HASHES)})
        return out

    a, b = sorted((chained(a), chained(b)), key=len)
    if not a:
        return float(not b)
    best = []
    for x in a:
        ratios = []
        for y in b:
            chance = len(x) * len(y) / digest.BITS
            ratios.append(min(1.0, max(0.0, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9))))
        best.append(max(ratios))
    return sum(best) / len(best)


def test_likeness_matches_brute_force(texts):
    some = [t.encode() for t in list(texts.values())[:25]] + [b"", b"x", b"a" * 5000, b"a" * 5001]
    found = digest.features(some)
    for i, a in enumerate(found):
        for b in found[i : i + 4]:
            assert abs(digest.likeness(digest.chain(a), digest.chain(b)) - brute_likeness(a, b)) < 1e-9
    assert digest.likeness(digest.chain(found[-1]), digest.chain(found[-2])) == 1.0


def test_short_edited_texts_and_strangers_are_apart():
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(800)]
    for size in (100, 200, 300):
        texts = [" ".join(rng.choice(words, 80))[:size] for _ in range(60)]
        own = [digest.chain(f) for f in digest.features([t.encode() for t in texts])]
        other = [digest.chain(f) for f in digest.features([digest.edited(t, n).encode() for t, n in zip(texts, texts[1:] + texts[:1])])]
        near = [digest.likeness(a, e) for a, e in zip(own, other)]
        far = [digest.likeness(a, n) for a, n in zip(own, own[1:] + own[:1])]
        assert min(near) > max(far) and np.mean(near) > 0.25


def test_features_do_not_depend_on_company(texts, monkeypatch):
    some = [t.encode() for t in list(texts.values())[:60]]
    together = digest.features(some)
    alone = [digest.features([t])[0] for t in some]
    assert all(np.array_equal(a, b) for a, b in zip(together, alone))
    monkeypatch.setattr(digest, "CHUNK", 900)
    assert all(np.array_equal(a, digest.features([t])[0]) for a, t in zip(together, some))


def check_digest(rows, pairs):
    """pairs: (doc_id, text, next text), as a multiset."""
    want = []
    for d, t, n in pairs:
        e = digest.edited(t, n)
        a, b, c = (digest.chain(digest.features([x.encode()])[0]) for x in (t, e, n))
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), digest.written(a), digest.written(b), digest.likeness(a, b), digest.likeness(a, c)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows]
    assert sorted(got) == sorted(want)


def test_neighbours_match_brute_force(spark, sf, texts):
    ids = sorted(texts, reverse=True)
    rows = queries.op3_fingerprint(spark, sf).collect()
    check_digest(rows, [(d, texts[d], texts[n]) for d, n in zip(ids, ids[1:] + ids[:1])])
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_digest_odd_rows(spark, odd, odd_rows, none):
    order = {r.i: r.h for r in spark.createDataFrame([(i, r[1] or "") for i, r in enumerate(odd_rows)], "i int, t string").select("i", F.xxhash64("t").alias("h")).collect()}
    seq = [r[1] for r in sorted(((-(r[0] if r[0] is not None else -1), order[i], i), (r[0], r[1] or "")) for i, r in enumerate(odd_rows))]
    rows = digest.compare_neighbours(odd).collect()
    check_digest(rows, [(d, t, n) for (d, t), (_, n) in zip(seq, seq[1:] + seq[:1])])
    assert digest.compare_neighbours(none).count() == 0
    assert digest.fingerprints(odd).count() == len(odd_rows)


def test_language_held_out_accuracy(spark, sf, docs):
    rows = queries.op5_langid(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(docs, odd, odd_rows, none):
    model = langid.train(docs)
    rows = langid.predict(odd, model, odd.columns, ("found", "sure", "kin")).select("size", F.col("found").alias("lang_pred")).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        text = odd_rows[r["size"]][1]
        assert (r.lang_pred == langid.UNKNOWN) == (not any(c.isalpha() for c in text or ""))
    assert langid.predict(none, model, ["doc_id"]).count() == 0
    assert langid.train(none).families == []
    assert langid.Model().predict("words") == (langid.UNKNOWN, 0.0, None)


def test_long_text_is_counted_in_slices(monkeypatch):
    text = "ein langer Text mit Wörtern " * 500
    whole = langid.features(text)
    monkeypatch.setattr(langid, "SLICE", 1000)
    assert np.allclose(whole, langid.features(text))
