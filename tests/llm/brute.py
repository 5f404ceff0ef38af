"""Plain versions to compare with, one document at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from tokenizers import Tokenizer

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BYTE_BPE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORD_BPE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
WHITE = " \t\n\x0b\x0c\r"


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def shingles(text):
    words = (text or "").encode().translate(LOW).split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k: k + 5]) for k in range(len(words) - 4)}


def components(docs):
    """doc_id -> smallest doc_id reachable, over all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in docs}, sets


def without_repeats(rows, length=100):
    """(id, text) in order -> (bytes, removed, spans, kept bytes) by id."""
    seen, out = set(), {}
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            part = raw[p: p + length]
            if part in seen:
                gone[p: p + length] = b"\1" * length
            else:
                seen.add(part)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, bytes(x for x, g in zip(raw, gone) if not g))
    return out


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(*values):
    seed = 42
    for x in values:
        seed = xxhash.xxh64(x if isinstance(x, bytes) else (x & (2**64 - 1)).to_bytes(8, "little"), seed=seed).intdigest()
    return _signed(seed)


def sketch(text):
    h = [_hash(w.encode()) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    whole = [(_hash(*h) & (2**64 - 1)) >> 32]
    m = [_hash(a, b) for a, b in zip(h, h[1:])]
    places = {}
    for i in range(len(h) - 4):
        if min(m[i], m[i + 3]) <= min(m[i + 1], m[i + 2]):
            places.setdefault((_hash(m[i], m[i + 2], m[i + 3]) & (2**64 - 1)) >> 32, i)
    return sorted(places.items())[:64] or [(whole[0], 0)]


def likeness(a, b):
    joint, a, b = sorted({x for x, _ in (*a, *b)})[:64], dict(a), dict(b)
    apart = sorted(a[x] - b[x] for x in joint if x in a and x in b)
    if not apart:
        return 0
    middle = (apart[(len(apart) - 1) // 2] + apart[len(apart) // 2]) / 2
    return sum(abs(x - middle) <= max(8, max(*a.values(), *b.values()) // 8) for x in apart) / len(joint)


class _Article(HTMLParser):
    """The blocks of the article elements of a simple page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks += [""] if tag in ("p", "h1") else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks += [""] if tag in ("p", "h1") else []

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def article(page):
    reader = _Article()
    reader.feed(page)
    reader.close()
    return "\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)


def base_scores(docs):
    tokens = {i: (t or "").encode().translate(LOW).split() + [None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws))
            for i, ws in tokens.items()}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants(counts):
    """Word -> n to the rows (word, form, root, n, n_near, form_n)."""
    book = defaultdict(set)
    for w in counts:
        for short in {w} | {w[:k] + w[k + 1:] for k in range(len(w))}:
            book[short].add(w)
    close = {w: {v for short in {w} | {w[:k] + w[k + 1:] for k in range(len(w))} for v in book[short] if near(w, v)} for w in counts}
    best = {w: min(close[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: v if v is not None and counts[v] >= 10 * counts[w] else None for w, v in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(close[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def corpus_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.encode().translate(LOW).decode()
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def without_common_lines(rows, least):
    """(id, text) -> rows (id, lines, dropped, text that stays); rows of one id are one document."""
    def key(line):
        return line.strip(WHITE).encode().translate(LOW).decode()

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def alignments(rows):
    """(id, text) -> rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    found, count = [], Counter()
    for i, text in rows:
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = PIECES.encode(text) if text else []
        a_raw = [bytes(byte_of[c] for c in a_of.id_to_token(x)) for x in a]
        b_raw = [bytes([int(p[3:5], 16)]) if PIECES.is_byte(x) else p.replace("\u2581", " ").encode() for x in b for p in [PIECES.id_to_piece(x)]]
        if not text or b"".join(a_raw) != f" {text}".encode() or b"".join(b_raw) != f" {text}".encode():
            found.append((i, [], [], [], []))
            continue
        a_end, b_end = ({e: k for k, e in enumerate(np.cumsum([len(x) for x in raw]).tolist(), 1)} for raw in (a_raw, b_raw))
        x = y = 0
        groups, links = [], []
        for e in sorted(a_end.keys() & b_end.keys()):
            groups.append(",".join(map(str, a[x: a_end[e]])) + "|" + ",".join(map(str, b[y: b_end[e]])))
            x, y = a_end[e], b_end[e]
            links.append((a[x - 1], b[y - 1]))
        count.update(links)
        found.append((i, a, b, groups, links))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(i, len(a), len(b), len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), ";".join(g))
            for i, a, b, g, links in found]
