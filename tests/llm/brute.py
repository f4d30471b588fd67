"""Plain Python forms of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def removed_runs(flags) -> int:
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def suffix_dedup(docs, size=100):
    """docs: (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        flags = bytearray(len(data))
        for i in range(len(data) - size + 1):
            window = data[i : i + size]
            if window in seen:
                flags[i : i + size] = b"\1" * size
            seen.add(window)
        out[doc_id] = (len(data), sum(flags), removed_runs(flags), sha(bytes(b for b, f in zip(data, flags) if not f)))
    return out


def substring_dedup(docs, size=35):
    words = {d: WORD.findall(t or "") for d, t in docs}
    times = Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if times[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text, n=5):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard_join(docs, percent=75):
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for token in s:
            holders[token].append(d)
    pairs = {p for ds in holders.values() for p in combinations(sorted(ds), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def line_dedup(docs, min_chars=40, min_docs=5):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: lower(line.strip(blank))
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def quality(docs):
    out = {}
    for d, t in docs:
        text = t or ""
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pii(docs):
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    out = {}
    for d, t in docs:
        found, counts = [], []
        for k, (name, pattern, good) in enumerate(kinds):
            mine = [(m.start(), k, m.end()) for m in re.finditer(pattern, t or "") if good(m[0])]
            counts.append(len(mine))
            found += mine
        text = ",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(found))
        out[d] = (*counts, sha(text), text)
    return out


def pii_terms(docs, support=3, remove=0.9, generalise=0.8):
    """Per row: (start, end, action) of the terms that disclose an entity of its text."""
    texts, kinds = [t or "" for _, t in docs], ("email", "ip", "card", "phone")
    held, terms, covered = [], [], []
    for text, spans in zip(texts, (x[5] for x in pii(list(enumerate(texts))).values())):
        spans = [(kinds.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
        held.append({(k, text[a:b].lower()) for k, a, b in spans})
        covered.append({p for _, a, b in spans for p in range(a, b)})
        terms.append([(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text) if len(m[0]) >= 4])
    outside = [[x for x in own if not covered[i] & set(range(x[0], x[1]))] for i, own in enumerate(terms)]
    n, df_entity = len(texts), Counter(e for es in held for e in es)
    df_term = Counter(w for own in outside for w in {x[2] for x in own})
    co = Counter((e, w) for es, own in zip(held, outside) for e in es for w in {x[2] for x in own})
    action = {}
    for (e, w), c in co.items():
        if c >= support and n > df_entity[e]:
            ratio = math.log(c * n / (df_entity[e] * df_term[w])) / math.log(n / df_entity[e])
            if ratio >= generalise:
                action[e, w] = "remove" if ratio >= remove else "generalise"
    return [sorted((a, b, max(action[e, w] for e in es if (e, w) in action)) for a, b, w in own if any((e, w) in action for e in es)) for es, own in zip(held, outside)]


def chat(rows):
    """rows: (conv_id, turn, role, text)"""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((t, r or "", x or ""))
    return {c: (len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in sorted(ts))), sum(len(x) for _, r, x in ts if r == "assistant"), sha("".join(x for _, r, x in sorted(ts) if r == "assistant"))) for c, ts in turns.items()}


def packing_faults(docs, rows, encode, size=2048, end=1):
    """rows: dicts of the query. Returns what is wrong, and the share of padding."""
    faults, by_doc, by_seq = [], defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, t in docs:
        ids, at = [*encode(t or ""), end], 0
        for r in sorted(by_doc.pop(d, []), key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]]
            if r["start"] != at or not piece or r["doc_tokens"] != len(ids) or r["ids_crc32"] != zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece)):
                faults.append(("piece", r))
            at += r["length"]
        if at != len(ids):
            faults.append(("missing", d))
    faults += [("unknown", d) for d in by_doc]
    for s, rs in by_seq.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            if r["offset"] != at:
                faults.append(("offset", r))
            at += r["length"]
        if at > size:
            faults.append(("long", s))
    return faults, 1 - sum(r["length"] for r in rows) / (size * max(1, len(by_seq)))


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label) with distinct ids and one dimension."""
    kept = {i: ([math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    cut = lambda v: [tuple(v[k * len(v) // parts : (k + 1) * len(v) // parts]) for k in range(parts)]
    cuts = {i: cut(v) for i, (v, _) in kept.items()}
    books = [[cuts[i][k] for i in sorted(cuts)[:entries]] for k in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: {i: [min((apart(c[k], e), n) for n, e in enumerate(books[k])) for k in range(parts)] for i, c in cuts.items()}
    for _ in range(rounds):
        chosen = assign()
        for k in range(parts):
            for n in range(len(books[k])):
                mine = [c[k] for i, c in cuts.items() if chosen[i][k][1] == n]
                if mine:
                    books[k][n] = tuple(sum(x) // len(mine) for x in zip(*mine))
    final, by_label = assign(), Counter()
    for i, c in final.items():
        by_label[kept[i][1]] += sum(d for d, _ in c)
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    return {i: ("".join(f"{n:02x}" for _, n in c), sum(d for d, _ in c), by_label[kept[i][1]], digest) for i, c in final.items()}


def mix_targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """sizes: of each source by name, None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        spare = left - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else spare * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def divergence(rows, min_docs=30, top=50, added=5):
    """rows: (lang, source, text). Rows of the report as tuples."""
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))) for lang, source, t in rows]
    out = []
    for lang in {x[0] for x in terms}:
        own = [(s, w) for g, s, w in terms if g == lang]
        df = Counter(w for _, ws in own for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        scale = lambda c, n: 1 + 10**9 * (c + added) // (n + added * len(kept))

        def chances(counts):
            n = sum(counts[w] for w in kept)
            return [scale(counts[w], n) for w in kept]

        counts = {s: Counter(w for o, ws in own if o == s for w in ws) for s, _ in own}
        p, q = {s: chances(c) for s, c in counts.items()}, chances(Counter(w for _, ws in own for w in ws))
        for s in counts:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in counts if o != s]
            more = [(b - a, w.encode(), w) for w, a, b in zip(kept, p[s], q) if counts[s][w] and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(found)]
    return out
