"""The operators in plain Python, for tests."""

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def signed_hash(text):
    """Spark's xxhash64."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def jaccard_classes(rows, n=5):
    """Per row: the set's size and the smallest row number reachable by links."""
    sets = []
    for _, text in rows:
        w = words(ascii_low(text))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [root(i) for i in range(len(rows))]


def jaccard_join(rows, n=5):
    """doc_id, n_shingles, component_id."""
    size, root = jaccard_classes(rows, n)
    least = {}
    for r, (doc_id, _) in zip(root, rows, strict=True):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    # documents without words are linked with nothing
    return [(d, s, least.get(r) if s else d) for (d, _), s, r in zip(rows, size, root, strict=True)]


def quality(scored, labels):
    """Precision and recall at the threshold on held-out labelled rows."""
    m = scored[scored.held_out].merge(labels, on="doc_id")
    hit = int(((m.predicted == 1) & (m.toxic == 1)).sum())
    return {"precision": hit / max(1, int((m.predicted == 1).sum())), "recall": hit / max(1, int((m.toxic == 1).sum()))}


def substring_dedup(rows, size=20):
    """doc_id, n_words, n_removed, kept text; rows are in the order of doc_id."""
    seen, out = set(), []
    for doc_id, text in rows:
        got, gone = words(text), set()
        for i in range(len(got) - size + 1):
            w = tuple(got[i : i + size])
            if w in seen:
                gone.update(range(i, i + size))
            seen.add(w)
        out.append((doc_id, len(got), len(gone), " ".join(w for i, w in enumerate(got) if i not in gone)))
    return out


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
M64 = 2**64 - 1


def rolling(raw, i):
    """The rolling hash at byte i, from the seven bytes up to it."""
    out = 0
    for back in range(min(7, i + 1)):
        w = (raw[i - back] + 1) * 0x9E3779B97F4A7C15 & M64
        w ^= w >> 31
        out = (out + w * pow(0x2545F4914F6CDD1D, back, 2**64)) & M64
    out ^= out >> 33
    return out * 0xFF51AFD7ED558CCD & M64


def fingerprint(raw):
    """The piecewise hash byte by byte; chunk characters come from the same hash of the chunk's bytes."""
    from graphweave.llm import wordhash as H

    if not raw:
        return "3::"
    levels = []
    for i in range(len(raw)):
        h = rolling(raw, i)
        top = h >> 40 if i >= 6 else 0
        if top % 3 == 2:
            value, k = top // 3 & 0x1FFFFF | (h & 0xFFFFFF) << 21, 0
            while k < 29 and value >> k & 1:
                k += 1
            levels.append((i, k))

    powers = [1]

    def character(a, b):
        total, power = 0, powers[0]
        for byte in raw[a:b]:
            total = (total + int(H._BYTE[byte]) * power) & M64
            power = power * 0x9E3779B97F4A7C15 & M64
        import numpy as np

        return ALPHABET[int(H.mix(np.array([total], np.uint64))[0] >> np.uint64(58))]

    def signature(k, most):
        ends = [i + 1 for i, lv in levels if lv >= k][: most - 1]
        if not ends or ends[-1] != len(raw):
            ends.append(len(raw))
        return "".join(character(a, b) for a, b in zip([0, *ends], ends, strict=False))

    k = 0
    while (3 << k) * 64 < len(raw):
        k += 1
    while k and sum(lv >= k for _, lv in levels) < 31:
        k -= 1
    return f"{3 << k}:{signature(k, 64)}:{signature(k + 1, 32)}"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(x, y):
    if x == y:
        return 1.0
    (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
    p, q, best = int(p), int(q), 0.0
    for s, t in [(p1, q1), (p2, q2)] if p == q else [(p1, q2)] if p == 2 * q else [(p2, q1)] if q == 2 * p else []:
        need = min(7, max(len(s), len(t)))
        if any(s[i : i + need] in t for i in range(len(s) - need + 1)):
            best = max(best, 1 - edit_distance(s, t) / max(len(s), len(t)))
    return best


def fuzzy_hash(rows):
    """As the query: the next document is the next smaller doc_id, null last, ties by the text's hash."""
    import hashlib

    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed_hash(r[1])))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        own, changed, following = (fingerprint(x.encode()) for x in (t, new, after))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, following)))
    return out


def bpe(rows):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 with the tokenizers library."""
    import hashlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def spark_hash(*values):
    """xxhash64 of Spark: each value hashed with the hash before it as seed; int is 4 bytes, ("long", x) 8."""
    import struct

    import xxhash

    h = 42
    for v in values:
        if v is None or v == ("long", None):
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[1]) if isinstance(v, tuple) else struct.pack("<i", v)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - 2**64 if h >= 2**63 else h


def mix_copies(rows, max_repeats, blocks=4096, seed=17):
    """copies per row of (doc_id, text, source): weights by temperature, budget as the largest source seen once whole."""
    size = lambda t: len(words(t))
    totals = {}
    for _, text, source in rows:
        totals[source] = totals.get(source, 0) + size(text)
    most = max(totals.values(), default=0)
    least = min((n for n in totals.values() if n), default=0)
    # the smallest exponent at which the least source is seen max_repeats times at most, by bisection
    low, high = 0.0, 1.0
    if not most or (least / most) ** -1 <= max_repeats:
        high = 0.0 if most else 1.0
    else:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if (least / most) ** (mid - 1) <= max_repeats else (mid, high)
    epochs = {s: (n / most) ** (high - 1) if n else 1.0 for s, n in totals.items()}
    block = lambda d: spark_hash(seed, ("long", d)) % blocks

    def place(b, source, epoch):
        a = spark_hash(seed + 1, source, ("long", epoch)) % (blocks // 2) * 2 + 1
        return (b * a + spark_hash(seed + 2, source, ("long", epoch)) % blocks) % blocks

    places = {}
    for s, n in totals.items():
        whole = int(epochs[s] + 1e-9)
        held, last = 0, 0
        by_place = {}
        for d, text, source in rows:
            if source == s:
                p = place(block(d), s, whole)
                by_place[p] = by_place.get(p, 0) + size(text)
        for p in sorted(by_place):
            held += by_place[p]
            if held <= (epochs[s] - whole) * n - 1e-3:  # token counts are whole; the exponent is found to 3e-8 from above
                last = p + 1
        places[s] = last
    return [int(epochs[s] + 1e-9) + (place(block(d), s, int(epochs[s] + 1e-9)) < places[s]) for d, _, s in rows], epochs


def ftrl(examples, labels, epochs=4, alpha=0.4, beta=1.0, l1=8.0, l2=0.3):
    """Weights of each coordinate by a plain loop, the bias under None."""
    import math

    import numpy as np

    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[k]) - z[k]) / ((beta + math.sqrt(n[k])) / alpha + l2)

    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            keys = [*examples[i], None]
            w = {k: weight(k) for k in keys}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values())))))
            g = p - labels[i]
            for k in keys:
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


def toxic_features(text):
    """The distinct hashed words, pairs and pairs with a gap of a text, by the same hashes."""
    import numpy as np
    import pyarrow as pa

    from graphweave.llm import toxicity

    batch = pa.RecordBatch.from_arrays([pa.array([text or ""])], names=["text"])
    return sorted(set(toxicity.features(batch)[1].tolist())) if text else np.zeros(0, int).tolist()


def toxic_scores(rows, labels, fold=(4, 2)):
    """The score of each text: learned from labelled texts outside the fold, each once per doc_id, in the order of doc_id and hash."""
    import math
    import zlib


    known = {d: t for d, t in labels if t is not None and d is not None and zlib.crc32(str(d).encode()) % fold[0] != fold[1]}
    learn = sorted({(d, signed_hash(text or ""), text or "") for d, text in rows if d in known})
    w = ftrl([toxic_features(t) for _, _, t in learn], [float(known[d] > 0) for d, _, _ in learn])
    score = lambda t: 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.get(k, 0.0) for k in [*toxic_features(t), None])))))
    return [score(t) for _, t in rows]


def softmax_fit(rows, n_classes, bits, width, epochs=6, rate=0.8):
    """Table times weights by plain loops over rows of (grams, counts, label), trained on the first four fifths."""
    import math

    import numpy as np

    rng = np.random.Generator(np.random.PCG64(2))
    table, out = rng.normal(0, 0.1, (1 << bits, width)).tolist(), [[0.0] * n_classes for _ in range(width)]
    cut = max(1, len(rows) * 4 // 5)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(cut):
            grams, counts, label = rows[i]
            lr = rate * (1 - done / (epochs * cut))
            done += 1
            total = sum(counts)
            if not total:
                continue
            mean = [sum(table[g][d] * c / total for g, c in zip(grams, counts, strict=True)) for d in range(width)]
            logit = [sum(mean[d] * out[d][k] for d in range(width)) for k in range(n_classes)]
            top = max(logit)
            e = [math.exp(x - top) for x in logit]
            err = [x / sum(e) - (k == label) for k, x in enumerate(e)]
            back = [sum(out[d][k] * err[k] for k in range(n_classes)) for d in range(width)]
            for d in range(width):
                for k in range(n_classes):
                    out[d][k] -= lr * mean[d] * err[k]
            for g, c in zip(grams, counts, strict=True):
                for d in range(width):
                    table[g][d] -= lr * c / total * back[d] * 10
    return [[sum(table[g][d] * out[d][k] for d in range(width)) for k in range(n_classes)] for g in range(1 << bits)]
