"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for _, text, _ in rows]


def targets(rows):
    """Target words of each source, as exact fractions of the whole."""
    from fractions import Fraction

    size = defaultdict(int)
    for (_, _, source), n in zip(rows, sizes(rows), strict=True):
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        share = {s: Fraction(3 * size[s]) if s in full else Fraction(rest * weight[s], free)
                 for s in order}
        over = {s for s in order if s not in full and share[s] > 3 * size[s]}
        if not over:
            return size, share
        full |= over


def repeats(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256) by all 50-byte strings."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - 49):
            first[b[s:s + 50]] = min(i, first.get(b[s:s + 50], i))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < i:
                gone[s:s + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, sha(kept))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def exact_classes(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, sha(norm))
    return out


def _hash(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed & (2**64 - 1))


def line_chunks(text):
    lines = (text or "").split("\n")
    hashes, out, now = [_hash(x.encode()) for x in lines], [], []
    for k, line in enumerate(lines):
        now.append(line)
        before = hashes[k - 1] if k else 0
        rolled = _hash(struct.pack("<Q", hashes[k]), _hash(struct.pack("<Q", before)))
        if (rolled - 2**64 if rolled >> 63 else rolled) % 4 == 0:
            out.append(now)
            now = []
    return out + [now] if now else out


def line_removals(rows):
    """doc_id -> (n_lines, n_chunks, n_removed, removed_lines, text kept)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        chunks, kept, gone, lines = line_chunks(t), [], 0, 0
        for c in chunks:
            text = "\n".join(c)
            if len(c) >= 2 and text in seen:
                gone, lines = gone + 1, lines + len(c)
            else:
                if len(c) >= 2:
                    seen.add(text)
                kept.append(text)
        out[i] = ((t or "").count("\n") + 1, len(chunks), gone, lines, "\n".join(kept))
    return out


def passage_lines(rows, words=50):
    """(doc_id, line) of all lines in runs of 2+ lines and over ``words`` words of an earlier text."""
    texts = [(i, (t or "").split("\n")) for i, t in sorted(rows)]
    gone = set()
    for d, (i, lines) in enumerate(texts):
        for _, earlier in texts[:d]:
            for shift in range(1 - len(earlier), len(lines)):
                run = []
                for k in range(max(shift, 0), min(len(lines), len(earlier) + shift) + 1):
                    if k < min(len(lines), len(earlier) + shift) and lines[k] == earlier[k - shift]:
                        run.append(k)
                        continue
                    if len(run) > 1 and sum(len(re.findall(r"\S+", lines[j])) for j in run) > words:
                        gone |= {(i, j) for j in run}
                    run = []
    return gone


def chunk_lines(rows):
    """(doc_id, line) of all lines in repeated chunks."""
    seen, gone = set(), set()
    for i, t in sorted(rows):
        k = 0
        for c in line_chunks(t):
            text = "\n".join(c)
            if len(c) >= 2 and text in seen:
                gone |= {(i, j) for j in range(k, k + len(c))}
            elif len(c) >= 2:
                seen.add(text)
            k += len(c)
    return gone


def contaminated(rows, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        own = words(text)
        m = min(window, len(own))
        for k in range(len(own) - m + 1 if m else 0):
            wins[tuple(own[k:k + m])].add(item)
    lengths, out = sorted({len(w) for w in wins}), {}
    for i, text in rows:
        own, hit, found = words(text), set(), set()
        for m in lengths:
            for k in range(len(own) - m + 1):
                if tuple(own[k:k + m]) in wins:
                    hit.update(range(k, k + m))
                    found |= wins[tuple(own[k:k + m])]
        ids = sorted(str(x) for x in found if x is not None)
        out[i] = (len(own), len(hit), len(ids), sha(",".join(ids)), bool(hit))
    return out


def token_index(rows, tokenizer, end_id=1):
    start, out = 0, {}
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        out[i] = (start, len(ids), zlib.crc32(b"".join(struct.pack("<I", x) for x in ids)))
        start += len(ids)
    return out


def jaccard_classes(rows, width=5, similar=0.8):
    """doc_id -> (class_id, class_rows, n_links)."""
    texts = defaultdict(list)
    out = {}
    for i, t in rows:
        own = words(t)
        if not own:
            out[i] = (i, 1, 0)
            continue
        texts[frozenset(tuple(own[k:k + width]) for k in range(max(1, len(own) - width + 1)))].append(i)
    sets, where = list(texts), defaultdict(list)
    degree, parent = [0] * len(sets), list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in enumerate(sets):
        for j, n in Counter(j for t in s for j in where[t]).items():
            if n >= similar * (len(s) + len(sets[j]) - n) - 1e-9:
                degree[i] += 1
                degree[j] += 1
                parent[root(i)] = root(j)
        for t in s:
            where[t].append(i)
    members = defaultdict(list)
    for i, s in enumerate(sets):
        members[root(i)] += texts[s]
    for i, s in enumerate(sets):
        own = members[root(i)]
        for x in texts[s]:
            out[x] = (min(own), len(own), degree[i])
    return out


def _checksum(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base_scores(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    import math

    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t))) for i, t in rows]
    c, ends = Counter(), 0
    for i, w in split:
        if _checksum(i) % 7 != 2:
            c.update(w)
            ends += 1
    total, kinds = sum(c.values()) + ends, len(c) + (ends > 0)
    share = math.log10(total + kinds + 1)
    return [(i, _checksum(i) % 7 == 2, len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), total,
             sum(math.log10(c[x] + 1) for x in w) + math.log10(ends + 1) - (len(w) + 1) * share)
            for i, w in split]


def spelt(word, pieces, p):
    """Probability of a word over all its segmentations."""
    known = {x: q for x, q in zip(pieces[256:], p[256:], strict=True)}
    letters = ["▁", *("\U0010ffff" if c == "▁" else c for c in word)]  # no mark inside a word
    ways = [1.0] + [0.0] * len(letters)
    for t in range(1, len(letters) + 1):
        for d in range(1, t + 1):
            x = "".join(letters[t - d:t])
            if x in known:
                ways[t] += ways[t - d] * known[x]
            elif d == 1:
                q = 1.0
                for b in x.replace("\U0010ffff", "▁").encode():
                    q *= p[b]
                ways[t] += ways[t - d] * q
    return ways[-1]


def periodic(w, least=12):
    """(start, length, period) of all runs."""
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            end = i + q
            if end - s >= max(least, 2 * q) and not any(a <= s and b >= end for a, b, _ in found):
                found.append((s, end, q))
    return sorted((a, b - a, q) for a, b, q in found)


def collapsed(w):
    gone = {x for s, n, q in periodic(w) for x in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def looped(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), _checksum(doc_id)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def run_digests(rows):
    out = []
    for i, t in rows:
        w = looped(i, t)
        runs = periodic(w)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        out.append((i, len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2])
                                    if best else (None,) * 4),
                    sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(collapsed(w)))))
    return out


def merkle(rows, fan=16):
    """Rows (doc_id, source, lang, n_chars, text) as leaves, with folded proofs."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, tampered=False):
        text = low(r[4]) if tampered and r[4] is not None else r[4]
        return sha("".join(map(field, (*r[:4], text))))

    def tree(nodes):
        paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            above, joined = [], []
            for a in range(0, len(nodes), fan):
                run = nodes[a:a + fan]
                for k, members in enumerate(groups[a:a + fan]):
                    for i in members:
                        paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
                above.append(sha("".join(run)))
                joined.append([i for g in groups[a:a + fan] for i in g])
            nodes, groups = above, joined
        return nodes[0], paths

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    trees = []
    for s in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own])))
    root, upper = tree([t[1] for t in trees]) if trees else ("", [])
    out = []
    for (own, subroot, paths), top in zip(trees, upper, strict=True):
        for r, path in zip(own, paths, strict=True):
            node = leaf(r, r[0] is not None and _checksum(r[0]) % 5 == 0)
            for left, right in path + top:
                node = sha(left + node + right)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in path + top)),
                        node, node == root))
    return out
