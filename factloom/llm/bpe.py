"""BPE encoding by a transducer with bounded lookahead, and incremental decoding.

Nulls encode as the empty text; the empty text has no tokens. Repeated rows give
repeated results. Columns other than the id and the text are not read. Very long texts are
whole: what is held beside a text is one piece of it, its longest word and its digests
so far. An empty table gives no rows.
"""

import codecs
import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import islice, pairwise

import regex

from .common import map_columns, table

#: White space of the Unicode standard; it separates words and is dropped. Fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: The rank of pairs that no rule merges.
NEVER = 1 << 60


def byte_letters():
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def reaches(merges, size):
    """For each token, how many symbols after its end can decide whether it stays.

    Merges apply in order of priority, so one pass suffices: after each rule, the
    left part depends on the right part and on what that depends on; the right
    part and the product depend on both. `size` gives a token's symbols.
    """
    reach = {}
    for a, b in merges:
        ra, rb = reach.get(a, 0), reach.get(b, 0)
        made = max(ra - size(b), rb, 0)
        for token, r in ((a, size(b) + rb), (b, made), (a + b, made)):
            reach[token] = max(reach.get(token, 0), r)
    return reach


class Merges:
    """A merge list with ranks and its sufficient lookahead."""

    def __init__(self, merges, ends=""):
        self.rank = {tuple(m): i for i, m in reversed(list(enumerate(merges)))}
        self.size = lambda t: len(t.removesuffix(ends)) if ends else len(t)
        self.reach = reaches([tuple(m) for m in merges], self.size)
        self.lookahead = max(self.reach.values(), default=0)

    #: Up to this many symbols a scan for the first rule costs less than a heap.
    SHORT = 40

    def merge(self, symbols):
        """The tokens of the whole list of symbols."""
        n = len(symbols)
        if n <= self.SHORT:
            return self.scan(list(symbols))
        token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j], after[i] = a + b, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get((token[x], token[y]))) is not None:
                    heapq.heappush(heap, (r, x, token[x], token[y]))
        return [t for t in token if t is not None]

    def scan(self, token):
        """The same for few symbols: the best rule's leftmost place is merged until no rule applies."""
        ranks = [self.rank.get(pair, NEVER) for pair in pairwise(token)]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            token[i : i + 2] = [token[i] + token[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.rank.get((token[i - 1], token[i]), NEVER)
            if i < len(ranks):
                ranks[i] = self.rank.get((token[i], token[i + 1]), NEVER)
        return token

    def stream(self, symbols):
        """Tokens of an iterable of symbols, each as soon as it is stable.

        Held are the symbols from the last stable token on: no more than the block, which
        grows only where a single token and its lookahead are longer.
        """
        block, held, source = 4 * self.lookahead + 64, [], iter(symbols)
        while True:
            held += islice(source, block - len(held))
            last, done = len(held) < block, 0
            for t in self.merge(held):
                if not last and done + self.size(t) + self.lookahead > len(held):
                    break
                done += self.size(t)
                yield t
            if last:
                return
            if not done:
                block *= 2
            del held[:done]


class Remembered(dict):
    """Results of a function of short texts, remembered while there is room; long texts are computed anew."""

    def __init__(self, make, room=300_000, longest=64):
        super().__init__()
        self.make, self.room, self.longest = make, room, longest

    def __missing__(self, text):
        made = self.make(text)
        if len(text) <= self.longest:
            if len(self) >= self.room:
                self.clear()
            self[text] = made
        return made


class WordBpe:
    """A lower-casing word BPE as its vocabulary file describes it."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ends = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: Tokens' names by id, as a number or as text.
        self.name = {k: t for t, i in (self.ids | self.special).items() for k in (i, str(i))}
        self.decodes = spec.get("decoder") is not None
        self.merges = Merges([m.split(" ") if isinstance(m, str) else m for m in model["merges"]], self.ends)
        self.letters = byte_letters()
        self.value = {c: b for b, c in self.letters.items()}
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", SPACES))
        self.gaps = regex.compile(f"[{SPACES}]+")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words, self.chunks = Remembered(self.word), Remembered(self.chunk)

    def word(self, word):
        """Ids as text of one word of the split."""
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.ends
        return " ".join([str(self.ids[t]) for t in self.merges.stream(symbols)])

    def chunk(self, chunk):
        """Ids as text of a text without white space."""
        # lower-casing goes letter by letter, so a final sigma has no form of its own
        low = chunk.lower() if chunk.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", chunk)])
        return " ".join(map(self.words.__getitem__, self.split.findall(low)))

    def pieces(self, text):
        """Ids as text, joined by spaces, of one part of the text after the other; a part is some WINDOW letters up to a white space."""
        for part in self.parts.split(text) if "<|" in text else [text]:
            if part in self.special:
                yield str(self.special[part])
                continue
            odd, at = any(c in part for c in "\x1c\x1d\x1e\x1f"), 0
            while at < len(part):
                gap = self.gaps.search(part, at + self.WINDOW)
                end = gap.end() if gap else len(part)
                some = part[at:end] if at or gap else part
                if coded := " ".join(filter(None, map(self.chunks.__getitem__, self.gaps.split(some) if odd else some.split()))):
                    yield coded
                at = end

    #: Letters of a part of a text that is encoded at once.
    WINDOW = 1 << 16

    def encode(self, text):
        """The ids' decimal text joined by spaces, and their number."""
        coded = " ".join(self.pieces(text))
        return coded, coded.count(" ") + 1 if coded else 0

    def decoder(self, plain=None):
        """A decoder of this vocabulary; plain: whether it gives the bytes' text rather than the tokens' names, by default as the file says."""
        return Decoder(self, self.decodes if plain is None else plain)

    def token_text(self, ids):
        """What the vocabulary's own decoder gives."""
        state = self.decoder()
        return state.feed(ids) + state.end()

    def text(self, ids):
        """Pieces of text, as soon as their bytes are whole; broken bytes become U+FFFD."""
        state = self.decoder(plain=True)
        for i in ids:
            yield state.feed([i])
        yield state.end()


class Decoder:
    """The incremental decoding of ids: what it gives for parts of them is the text of the whole.

    Its state is a flag, whether a token came before, and the bytes of a letter that is not
    whole yet. A vocabulary without a decoder of its own gives its tokens' names, joined by
    spaces; otherwise bytes become text, and the end of a word a space.
    """

    def __init__(self, bpe, plain):
        self.bpe, self.plain, self.begun = bpe, plain, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids):
        """The text that these ids add."""
        names = [self.bpe.name[i] for i in ids]
        if not names:
            return ""
        if not self.plain:
            said, self.begun = (" " if self.begun else "") + " ".join(names), True
            return said
        out = []
        for name in names:
            if name in self.bpe.special:
                out.append(self.state.decode(b"", True) + name)
                self.state.reset()
                continue
            ended = self.bpe.ends and name.endswith(self.bpe.ends)
            out.append(self.state.decode(bytes([self.bpe.value[c] for c in (name.removesuffix(self.bpe.ends) if ended else name)])) + " " * bool(ended))
        return "".join(out)

    def end(self):
        """What the bytes that are left become."""
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def loaded(path):
    """The tokenizer of a vocabulary file, loaded once in a worker."""
    return WordBpe(path)


def encode_decode(docs, path, doc_id="doc_id", text="text"):
    """Per row: the id, n_tokens, ids (decimal, joined by a space), decoded (what the vocabulary's decoder gives), and the text of the ids' bytes."""

    def make():
        bpe = loaded(path)

        def step(ids, texts):
            coded = [bpe.encode(t or "") for t in texts]
            return ids, [n for _, n in coded], [c for c, _ in coded], [bpe.token_text(c.split()) for c, _ in coded], ["".join(bpe.text(c.split())) for c, _ in coded]

        return step

    return map_columns(docs, [doc_id, text], make, f"{doc_id} bigint, n_tokens bigint, ids string, decoded string, decoded_text string")


def digest(bpe, text, keep=False):
    """(n_tokens, digest of the ids, digest of the decoded text, ids if they are kept) of a text, piece by piece."""
    coded, said, decoder, n, kept = hashlib.sha256(), hashlib.sha256(), bpe.decoder(), 0, []
    for piece in bpe.pieces(text):
        ids = piece.split()
        coded.update((" " + piece if n else piece).encode())
        said.update(decoder.feed(ids).encode())
        n += len(ids)
        if keep:
            kept.append(piece)
    said.update(decoder.end().encode())
    return (n, coded.hexdigest(), said.hexdigest(), *([" ".join(kept)] if keep else []))


def digests(docs, path, with_ids=False):
    """The digests of `encode_decode`, made in the same task so that ids are only moved if asked for."""

    def make():
        bpe = loaded(path)

        def step(ids, texts):
            out = [digest(bpe, t or "", with_ids) for t in texts]
            return [ids, *map(list, zip(*out, strict=True))] if out else [[] for _ in range(4 + with_ids)]

        return step

    return map_columns(docs, ["doc_id", "text"], make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids string" * with_ids)


def op5_bpe(spark, sf_dir):
    """Digests of every whole text's ids and decoded text."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
