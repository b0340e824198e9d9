"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import html
import math
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower_words(text):
    return words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    w = lower_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or frozenset([tuple(w)])


def components(docs):
    """doc_id -> smallest doc_id reachable by Jaccard links of 0.75 (docs: id -> text)."""
    sets = {d: shingles(t) for d, t in docs.items()}
    index = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            index[g].append(d)
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for other in {o for g in s for o in index[g] if o < d}:
            common = len(s & sets[other])
            if 100 * common >= 75 * (len(s) + len(sets[other]) - common):
                a, b = find(d), find(other)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in docs}


def repeated_words(w):
    runs = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    return len({j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)})


def quality_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_repeat = repeated_words(w)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": n_repeat,
        "base_failed": len(w) < 50 or 100 * n_repeat > 50 * len(w),
    }


def window_counts(texts, window):
    counts = collections.Counter()
    for t in texts:
        for k in range(len(t) - window + 1):
            counts[t[k : k + window]] += 1
    return counts


def removed(text, counts, window):
    """(bytes removed, spans, kept bytes) of one text."""
    mark = bytearray(len(text))
    for k in range(len(text) - window + 1):
        if counts[text[k : k + window]] > 1:
            mark[k : k + window] = b"\1" * window
    spans = sum(1 for k, x in enumerate(mark) if x and (k == 0 or not mark[k - 1]))
    return sum(mark), spans, bytes(b for b, x in zip(text, mark, strict=True) if not x)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def article_text(source):
    """Main text of pages built like the driver's."""
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.DOTALL)[1]
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
    return "\n\n".join(b for b in blocks if b)


def planted_words(doc_id, text):
    """The words of a text; for a tenth of the ids a stretch of them is repeated."""
    import zlib

    w, h = words(text), zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs(w):
    """(start, length, period) of every run of words, period by period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def tree(leaves):
    """(top, siblings of each leaf as (on the right, hash or nothing)) of a binary tree over leaves."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for path, k in zip(paths, at, strict=True):
            other = k ^ 1
            path.append((k % 2 == 0, level[other] if other < len(level) else ""))
        level = [sha("".join(level[k : k + 2]).encode()) for k in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], paths


def fold(node, path):
    for right, other in path:
        node = sha((node + other if right else other + node).encode())
    return node


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode())


def winnowed(text, k, window):
    """{position: stretch} a window keeps by any order of the stretches, given as a function of them."""
    grams = [text[j : j + k] for j in range(max(len(text) - k + 1, 1))] if text else []
    return grams, [range(j, min(j + window, len(grams))) for j in range(max(len(grams) - window + 1, 1))] if grams else []


def item_words(text):
    """Lower-cased words; a character of a script without spaces is a word, ASCII and common marks are none."""
    out = []
    for c in text:
        k = ord(c)
        if k < 128:
            out.append(c.lower() if c.isalnum() else " ")
        elif 0x2000 <= k <= 0x203F or 0x3000 <= k <= 0x303F or 0xFF01 <= k <= 0xFF0F or 0xFF1A <= k <= 0xFF20:
            out.append(" ")
        elif any(a <= k <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x9FFF), (0x20000, 0x2FFFF))):
            out.append(f" {c} ")
        else:
            out.append(c)
    return [w for w in "".join(out).split(" ") if w]


def leaks(docs, items, threshold=0.5, overlap=0.5, run=3, k1=1.2, b=0.75):
    """(document, item) pairs by scoring every item against every passage; docs and items are lists of (id, text)."""
    own = [(i, t, item_words(t or "")) for i, t in items]
    own = [(i, t, w) for i, t, w in own if w]
    longest, mean = max(len(w) for *_, w in own), sum(len(w) for *_, w in own) / len(own)
    found_in = collections.Counter(w for *_, words_ in own for w in set(words_))
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    weighed = []
    for i, t, w in own:
        parts = {
            x: math.log(1 + (len(own) - found_in[x] + 0.5) / (found_in[x] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
            for x, tf in collections.Counter(w).items()
        }
        least = max(1, min(8, len(w) // 4))
        ends = [len(item_words(t[: m.end()])) for m in re.finditer(r"[.?!](?=[ \t-\r])|\n|[。！．？]", t)]
        cut = max([e for e in ends if least <= e <= len(w) - least], default=len(w) - max(least, len(w) // 4))
        weighed.append((i, w, parts, sum(parts.values()), w[:cut], w[cut:]))
    pairs = set()
    for d, text in docs:
        words_ = item_words(text or "")
        for p in range(max(1, -(-len(words_) // longest) - 1)):
            passage = words_[p * longest : (p + 2) * longest]
            there, sequences = set(passage), {n: grams(passage, n) for n in range(1, 5)}
            for i, w, parts, most, question, answer in weighed:
                if sum(v for x, v in parts.items() if x in there) < threshold * most - 1e-9:
                    continue
                if len(w) < 5:
                    ok = passage == w if len(w) == 1 else tuple(w) in sequences[len(w)]
                else:
                    shares = []
                    for part in (question, answer):
                        mine = grams(part, min(run, len(part)))
                        shares.append(len(mine & sequences[min(run, len(part))]) / len(mine))
                    ok = min(shares) >= overlap
                if ok:
                    pairs.add((d, i))
    return pairs
