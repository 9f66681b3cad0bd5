"""Plain versions of the operators, straight from their definitions, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from curricle.llm import line_chunks, quality_rules

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = " \t\n\x0b\x0c\r"


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def contamination(docs, items, size=13):
    """{doc_id: (n_words, n_hit, item ids, contaminated)} by comparing every window."""
    windows = defaultdict(set)
    for item, text in items:
        found = ITEM_WORD.findall(lower_ascii(text))
        for i in range(max(1, len(found) - size + 1) if found else 0):
            windows[tuple(found[i : i + size])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    result = []
    for doc_id, text in docs:
        found = ITEM_WORD.findall(lower_ascii(text))
        hit, by = set(), set()
        for i in range(len(found)):
            for n in sizes:
                if tuple(found[i : i + n]) in windows and i + n <= len(found):
                    hit.update(range(i, i + n))
                    by |= windows[tuple(found[i : i + n])]
        bad = len(hit) > 0 and 20 * len(hit) >= len(found)
        result.append((doc_id, len(found), len(hit), sorted(by), bad))
    return result


def quality(text):
    """The measurements of one text, and the failed rules."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    values = {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum((text or "").count(c) for c in quality_rules.SYMBOLS),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_upper_words": sum(x == x.upper() != x.lower() for x in w),
        "n_stutters": sum(a == b for a, b in zip(w, w[1:], strict=False)),
    }
    failed = {r.name for r in quality_rules.RULES if eval(r.fails.replace("OR", "or"), {}, values)}
    return values, failed


def chunks(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    result = []
    for i, line in enumerate(lines):
        rolled = hashes[i - 1] + (line_chunks.BASE * hashes[i - 2] if i > 1 else 0) if i else 0
        if i == 0 or rolled % line_chunks.MODULUS % line_chunks.DIVISOR == 0:
            result.append([])
        result[-1].append(line)
    return result


def dedup_lines(rows):
    """(doc_id, text left, lines removed) without later copies of chunks."""
    first = {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for number, chunk in enumerate(chunks(text) if text else []):
            first.setdefault(tuple(chunk), (doc_id, number))
    result = []
    for doc_id, text in rows:
        kept, gone = [], 0
        for number, chunk in enumerate(chunks(text) if text else []):
            if len(chunk) >= line_chunks.MIN_LINES and first[tuple(chunk)] != (doc_id, number):
                gone += len(chunk)
            else:
                kept.append("\n".join(chunk))
        result.append((doc_id, "\n".join(kept) if text else text, gone))
    return result


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=2):
    """Least id of each class: all pairs of fingerprints, links followed to the end."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    least = {}
    for doc_id, p in prints:
        root = find(p)
        known = [x for x in (least.get(root), doc_id) if x is not None]
        least[root] = min(known, default=None)
    return [(doc_id, f"{p:016x}", least[find(p)]) for doc_id, p in prints]


_TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encode(text):
    ids = _TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return ids, _TOKENIZER.decode(ids, skip_special_tokens=False)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_scores(rows):
    """Held-out flag, tokens, known tokens, training tokens and base score of each row."""
    tokens = lambda text: [*(text or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts, pairs = Counter(), Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            w = tokens(text)
            counts.update(w)
            pairs.update(zip([b"", *w[:-1]], w, strict=True))
    n, total = counts.total(), counts.total() + 0.5 * (len(counts) + 1)
    result = []
    for doc_id, text in rows:
        w = tokens(text)
        base = sum(math.log10((counts[x] + 0.5) / total) for x in w)
        result.append((doc_id, held(doc_id), len(w), sum(counts[x] > 0 for x in w), n, base))
    return result, counts, pairs, total, tokens
