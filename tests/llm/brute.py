"""Plain versions of the corpus operators, one row at a time, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return SPACE.findall(text or "")


def lower(text: str | None) -> str:
    return (text or "").translate(UPPER)


def judge(url: str | None, rules: list[tuple[str, str]]):
    """(host, path, rule, verdict of the rule)"""
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = lower(host)
    best = None
    for verdict, rule in rules:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else None


def base_secrets(text: str | None) -> list[tuple[int, str, int]]:
    text = text or ""
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [
        ("assign", rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return [(s, k, e) for s, _, k, e in sorted(found)]


def linked(text: str, strong: list, reach: int | None) -> list[tuple[int, str, int]]:
    """Weak parts of credentials, each compared with all others."""
    apart = lambda s, e: all(e <= a or s >= b for a, _, b in strong)
    word = lambda p, edge: [(m.start(), m.end()) for m in re.finditer(rf"(?<![{edge}]){p}(?![{edge}])", text) if apart(m.start(), m.end())]
    ids = [x for x in word("[A-Z0-9]{12,}", "A-Za-z0-9") if re.search("[0-9]", text[slice(*x)]) and re.search("[A-Z]", text[slice(*x)])]

    def mixed(t: str) -> bool:
        bits = -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
        return bits >= 3.5 and all(re.search(c, t) for c in ("[0-9]", "[A-Z]", "[a-z]"))

    keys = [x for x in word("[A-Za-z0-9+/_-]{20,}={0,2}", "A-Za-z0-9+/_=-") if mixed(text[slice(*x)])]
    places = [(m.start(), m.end()) for m in re.finditer(r"(?<![a-z0-9+])[a-z][a-z0-9+]*://[A-Za-z0-9._~:@%-]+|(?<![A-Za-z0-9.-])([a-z0-9-]+[.]){2,}[a-z0-9-]*:[0-9]{2,5}(?![0-9])", text) if apart(m.start(), m.end())]
    all_ids = ids + [(s, e) for s, k, e in strong if k == "access"]
    all_keys = keys + [(s, e) for s, k, e in strong if k != "access"]

    def near(x, y) -> bool:
        between = text[min(x[1], y[1]) : max(x[0], y[0])]
        return not re.search(r"\n[\x20\t\r]*\n", between) and (reach is None or max(x[0], y[0]) - min(x[1], y[1]) <= reach)

    out = [(*x, "id") for x in ids if any(near(x, y) for y in all_keys)] + [(*x, "key") for x in keys if any(near(x, y) for y in all_ids)]
    out += [(*x, "endpoint") for x in places if any(near(x, y) for y in all_ids) and any(near(x, y) for y in all_keys)]
    return sorted((s, k, e) for s, e, k in out)


def substrings(docs: dict, n: int = 35) -> dict:
    at = defaultdict(int)
    split = {d: words(t) for d, t in docs.items()}
    for w in split.values():
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])] += 1
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if at[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingle_set(text: str | None, n: int) -> set:
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def near(docs: dict, n: int, percent: int) -> dict:
    sets = {d: shingle_set(t, n) for d, t in docs.items()}
    root = {d: d for d in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    both = Counter()
    for own in holders.values():
        own.sort()
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                both[a, b] += 1
    for (a, b), k in both.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: (len(sets[d]), top(d)) for d in docs}


def unigram(docs: dict) -> dict:
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    toks = {d: [*words(lower(t)), None] for d, t in docs.items()}
    counts = Counter(x for d, w in toks.items() if not held[d] for x in w)
    total, kinds = sum(counts.values()), len(counts)
    return {d: (held[d], len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)) for d, w in toks.items()}


def suffix_tree(docs: dict, least_context: int, least_next: int, depth: int, held=lambda d: zlib.crc32(str(d).encode()) % 10 == 0):
    """A function (history, token) to log10 probabilities, from contexts that are dictionaries; None is the end of a text."""
    toks = [[*words(lower(t)), None] for d, t in docs.items() if not held(d)]
    counts = [Counter(tuple(w[i : i + k]) for w in toks for i in range(len(w) - k + 1)) for k in range(1, depth + 2)]
    total, kinds = counts[0].total(), len(counts[0])
    share = lambda w: (counts[0][(w,)] + 0.1) / (total + 0.1 * (kinds + 1))
    level = {g: share(g[0]) for g, n in counts[0].items() if n >= least_next}
    tree = {}
    for k in range(1, depth + 1):
        after, new = defaultdict(dict), {}
        for g, n in counts[k].items():
            if n >= least_next and g[:-1] in level and counts[k - 1][g[:-1]] >= least_context and g[1:] in level:
                after[g[:-1]][g[-1]] = n
        for c, nexts in after.items():
            nc = counts[k - 1][c]
            q = {w: level[(*c[1:], w)] for w in nexts}
            rest_p, rest_q = max(1e-12, 1 - sum(nexts.values()) / nc), max(1e-12, 1 - sum(q.values()))
            far = sum(n / nc * math.log(n / nc / q[w]) for w, n in nexts.items()) + rest_p * math.log(rest_p / rest_q)
            keep = 2 * nc * far > (len(nexts) + 1) * math.log(nc)
            new |= {(*c, w): (n - 0.5) / nc if keep else q[w] for w, n in nexts.items()}
            if keep:
                left = max(1e-12, 1 - sum(nexts.values()) / nc + 0.5 * len(nexts) / nc)
                tree[c] = ({w: (n - 0.5) / nc for w, n in nexts.items()}, math.log10(left / rest_q))
        level = new

    def logp(history: tuple, w) -> float:
        passed = 0.0
        for k in range(min(depth, len(history)), 0, -1):
            if (c := history[-k:]) in tree:
                told, loglam = tree[c]
                if w in told:
                    return passed + math.log10(told[w])
                passed += loglam
        return passed + math.log10(share(w))

    return logp, tree


def suffix_scores(docs: dict, *limits, **more) -> dict:
    logp, _ = suffix_tree(docs, *limits, **more)
    toks = {d: (*words(lower(t)), None) for d, t in docs.items()}
    return {d: sum(logp(w[max(0, i - limits[2]) : i], x) for i, x in enumerate(w)) for d, w in toks.items()}


def lines_left(docs: dict) -> dict:
    split = {d: (t or "").split("\n") for d, t in docs.items()}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, own in split.items():
        for x in own:
            if len(key(x)) >= 10:
                holders[key(x)].add(d)
    gone = lambda d, x: len(holders.get(key(x), ())) >= 2 and min(holders[key(x)]) != d
    return {d: [x for x in own if not gone(d, x)] for d, own in split.items()}


def lines(docs: dict) -> dict:
    return {d: (n := len((docs[d] or "").split("\n")), n - len(kept), sha("\n".join(kept))) for d, kept in lines_left(docs).items()}


def contamination(docs: dict, items: dict, n: int = 10) -> dict:
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for i, t in items.items():
        w = cut.findall(lower(t))
        if w:
            m = min(n, len(w))
            for k in range(len(w) - m + 1):
                wins[tuple(w[k : k + m])].add(str(i))
    sizes = {len(k) for k in wins}
    out = {}
    for d, t in docs.items():
        w = cut.findall(lower(t))
        hit, own = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in wins:
                    hit.update(range(k, k + m))
                    own |= wins[x]
        out[d] = (len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit))
    return out


def fingerprint(text: str, k: int = 3, slots: int = 32) -> list[str]:
    """Per slot the hash of the two least numbered k-mers, in text order; the slot's order is that of hash XOR slot."""
    symbols = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]{1,12}", text)]
    seen, found = Counter(), []
    for i in range(max(0, len(symbols) - k) + 1):
        h = 42
        for x in symbols[i : i + k]:
            h = xxhash.xxh64_intdigest(x, h)
        gram = (h - 2**64 if h >= 2**63 else h) >> 31
        e = xxhash.xxh64_intdigest(struct.pack("<i", seen[gram]), xxhash.xxh64_intdigest(struct.pack("<q", gram), 42)) & (2**32 - 1)
        seen[gram] += 1
        found.append((e, i))
    out = []
    for s in range(slots):
        two = sorted((e ^ s << 27, i) for e, i in found)[:2]
        h = 42
        for e, _ in sorted(two, key=lambda x: x[1]):
            h = xxhash.xxh64_intdigest(struct.pack("<q", e), h)
        out.append(f"{h:x}")
    return out


def fingerprints(docs: dict) -> dict:
    """(n_chars, sha of the edited text, print, edited print, near_edited, near_next)"""
    ids = sorted(docs)
    like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    own = {d: fingerprint(docs[d] or "") for d in ids}
    out = {}
    for i, d in enumerate(ids):
        after = ids[(i + 1) % len(ids)]
        t, nxt = docs[d] or "", docs[after] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        new = fingerprint(edited)
        out[d] = (len(t), sha(edited), ".".join(own[d]), ".".join(new), like(own[d], new), like(own[d], own[after]))
    return out


def hash64(*values) -> int:
    """The engine's 64-bit hash of longs and texts, nulls left out, as a signed number."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if v == 1 and not isinstance(v, Long) else "<q", v), h)
    return h - 2**64 if h >= 2**63 else h


class Long(int):
    """An eight-byte number; the plain 1 is the four-byte literal of a second hash."""


def uniform(seed: list[int], n: int) -> list[float]:
    import numpy as np

    return np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))).random(n).tolist()


def pivots(rows: list[tuple[float, float]], seed: list[int]) -> tuple[list[int], int | None, float]:
    """Rounds (size, part) one after the other; (roundings, the open one, its part)."""
    out, hold, q, draw = [0] * len(rows), None, 0.0, uniform(seed, len(rows))
    shut = lambda x: x <= 1e-9 or x >= 1 - 1e-9
    for i, (size, p) in enumerate(rows):
        if size <= 0 or p <= 1e-12:
            continue
        if p >= 1 - 1e-12:
            out[i] = 1
        elif hold is None:
            hold, q = i, p
        else:
            t = rows[hold][0]
            to_hold, to_i = min((1 - q) * t, p * size), min(q * t, (1 - p) * size)
            moved = to_hold if draw[i] * (to_hold + to_i) < to_i else -to_i
            q, p = q + moved / t, p - moved / size
            if shut(q):
                out[hold], hold = round(q), None
            if shut(p):
                out[i] = round(p)
            elif hold is None:
                hold, q = i, p
    return out, hold, q


def mixed(docs: dict, leaf: int, fan_in: int, weights=(3, 1, 2), share=1.5, most=2.0, seed=20) -> dict:
    """{id: (source size, target, words taken)} of {id: (text, source)} with distinct ids."""
    sources = sorted({s for _, s in docs.values()}, key=lambda s: (s is None, s or ""))
    size = {d: len(words(t)) for d, (t, _) in docs.items()}
    total = {s: sum(size[d] for d in docs if docs[d][1] == s) for s in sources}
    open_, left, target = [s for s in sources if total[s]], share * sum(size.values()), dict.fromkeys(sources, 0.0)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > most * total[s]]:
        target |= {s: most * total[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    out = {}
    for rank, s in enumerate(sources):
        own = [d for d in docs if docs[d][1] == s]
        rate, n = target[s] / total[s] if total[s] else 0.0, -(-len(own) // leaf)
        whole = math.floor(rate + 1e-12)
        of = defaultdict(list)
        for d in own:
            t = docs[d][0] or ""
            h1, h2 = hash64(t), hash64(1, t)
            of[hash64(Long(d), s, Long(size[d]), Long(h1), Long(h2)) % n].append((-size[d], d, h1, h2))
        extra, rest = dict.fromkeys(own, 0), []
        for k in sorted(of):
            rows = sorted(of[k])
            rounding, hold, q = pivots([(size[d], rate - whole) for _, d, *_ in rows], [seed, rank, k, 0])
            extra |= {d: r for (_, d, *_), r in zip(rows, rounding, strict=True)}
            if hold is not None:
                rest.append((k, rows[hold][1], q, k))
        deepest, level = len(own) // leaf + 1, 0
        while rest:
            level += 1
            last = deepest <= 1
            if not last:
                rest, deepest = [(k, d, q, node // fan_in) for k, d, q, node in rest], -(-deepest // fan_in)
            up = []
            for node in sorted({r[3] for r in rest}):
                rows = [r for r in rest if r[3] == node]
                rounding, hold, q = pivots([(size[d], p) for _, d, p, _ in rows], [seed, rank, node, level])
                extra |= {d: r for (_, d, _, _), r in zip(rows, rounding, strict=True)}
                if hold is not None and last:
                    extra[rows[hold][1]] = int(uniform([seed, rank, node, level, 1], 1)[0] < q)
                elif hold is not None:
                    up.append((rows[hold][0], rows[hold][1], q, node))
            rest = up
        out |= {d: (total[s], target[s], (whole + extra[d]) * size[d]) for d in own}
    return out
