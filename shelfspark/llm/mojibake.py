"""Garbled text from wrong character encodings.

Encoding pairs are derived, not listed: every one-byte encoding Python knows that keeps ASCII may
have been read, and every one of them (or UTF-8) that has all letters of an alphabet may have been
written. From these pairs garbled sequences are precomputed: what a letter's UTF-8 bytes look like,
signs that stand for letters, and pairs of letters that are much rarer than those they stand for.
One automaton of these sequences runs over each text, and only the words it hits are looked at. A
hit word is decoded by the pair that gives the likeliest text under a trigram model, of those pairs
that explain all its foreign characters, and its foreign characters are replaced if that is much
likelier than what stands there. Everything else stays as it is.

The model is counted over all texts (its size is bounded by the alphabet, not by the data) on top of
the alphabets' letter frequencies, so a text can be judged alone, too.
"""

from __future__ import annotations

import encodings
import pkgutil
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
LATIN = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
SIGNS = "«»—–‘’“”„…№°²³±·•×€§©®™½¼¾µ¿¡ºª\xa0"
_LETTERS = CYRILLIC + LATIN + ACCENTED
#: Classes of characters: 0 edge of a word, 1 digit, 2 usual sign, 3 anything else, 4... letters.
CLASS = {c: i + 4 for i, c in enumerate(_LETTERS)}
K = len(_LETTERS) + 4
_SIGNS = set(SIGNS)
_USUAL = set("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~") | (set(SIGNS) - set("€—–§©®™"))

#: Letters beyond ASCII an encoding must have to be one that was written, by alphabet.
ALPHABETS = (CYRILLIC, "äöüß", "àâçèéêëîïôùû", "àáâãçéêíóôõú")
# Frequencies of letters in texts, Russian and Latin (several languages), a thousandth.
FREQUENCIES = (
    dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 17, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4, 0.4))),
    dict(zip("enirsatdoluhcmgbfwkzpvjyxq", (140, 80, 75, 70, 70, 75, 70, 40, 55, 45, 45, 30, 30, 30, 20, 15, 15, 10, 10, 8, 25, 10, 3, 8, 3, 4))) | dict(zip("éèêàçãáíóõúäöüßâôîûùïëœ", (12, 3, 2, 4, 3, 4, 3, 3, 3, 1, 1, 4, 3, 6, 3, 1, 1, 0.5, 0.5, 0.5, 0.2, 0.2, 0.2))),
)
#: Trigrams the frequencies count for beside the corpus's.
PRIOR = 50_000
#: A restored word must be likelier by this many nats in all, and likely as such per trigram.
MARGIN, LIKELY = 8.0, -12.0
#: Nats a sign by which a word must be likelier if it is garbled by usual letters alone.
DOUBT = 1.5
#: Share of all pairs of letters from which one is expected in a text, and under which it is rare.
SEEN, RARE = 1e-4, 1e-4
#: Nats that a letter beyond the repertoire takes off a reading.
FOREIGN = 15.0
#: Most that a trigram with a character outside the repertoire is worth (such trigrams come from
#: the garbled texts themselves).
ODD = -16.0
#: Places within which a short word goes with a garbled one.
NEAR = 3
_SPLIT = regex.compile(r"[^ \t\n\r]+")


def _table(encoding: str) -> str | None:
    """Character of each byte; bytes the encoding leaves open stay control characters. None if it
    is no one-byte encoding that keeps ASCII."""
    out = []
    try:
        for b in range(256):
            c = bytes([b]).decode(encoding, "ignore")
            out.append(c or chr(b))
    except (LookupError, UnicodeError, AssertionError):
        return None
    return "".join(out) if len("".join(out)) == 256 and out[:128] == list(map(chr, range(128))) and len(set(out)) == 256 else None


#: Encodings in the order in which they are tried where several fit, the others follow by name.
USUAL = ("cp1252", "latin_1", "cp1251", "cp437", "cp866", "koi8_r", "mac_roman", "cp850", "cp1250", "mac_cyrillic", "iso8859_5", "iso8859_15")


def _tables() -> dict[str, str]:
    """All such encodings, each table once."""
    names = [*USUAL, *sorted(m.name for m in pkgutil.iter_modules(encodings.__path__) if not m.name.startswith(("utf", "unicode", "raw", "charmap", "ascii")))]
    out: dict[str, str] = {}
    for name in dict.fromkeys(names):
        table = _table(name)
        if table is not None and table not in out.values():
            out[name] = table
    return out


_DECODE = _tables()
_ENCODE = {e: {c: b for b, c in enumerate(t)} for e, t in _DECODE.items()}
#: Encodings in which UTF-8 may have been read.
UTF8_AS = tuple(_DECODE)


def _pairs() -> tuple[list[tuple[str, str]], list[dict[str, str]]]:
    """Pairs (as read, as written) of one-byte encodings, and for each what every garbled character
    stands for. Pairs that say the same of all letters are one; one that says less goes."""
    pairs: list[tuple[str, str]] = []
    maps: list[dict[str, str]] = []
    kept: dict[str, list[tuple[frozenset, int]]] = {}
    written = []
    for w in _DECODE:
        letters = "".join(a for a in ALPHABETS if all(c in _ENCODE[w] for c in a + a.upper() if len(c) == 1 and c not in "ßSÿ"))
        if letters:
            written.append((w, [c for c in dict.fromkeys(letters + letters.upper()) if c in _ENCODE[w]]))
    for r, table in _DECODE.items():
        for w, letters in sorted(written, key=lambda x: -len(x[1])):
            of = {table[_ENCODE[w][c]]: c for c in letters}
            key = frozenset(of.items())
            if all(c == x for c, x in key) or any(key <= k for k, _ in kept.get(r, ())):
                continue
            kept.setdefault(r, []).append((key, len(pairs)))
            pairs.append((r, w))
            maps.append(of | {table[_ENCODE[w][c]]: c for c in SIGNS if c in _ENCODE[w]})
    order = sorted(range(len(pairs)), key=lambda i: [list(_DECODE).index(e) for e in reversed(pairs[i])])
    return [pairs[i] for i in order], [maps[i] for i in order]


BYTE_PAIRS, _MAPS = _pairs()
#: What stands for the pair where UTF-8 was misread.
UTF8 = ("utf_8", "utf_8")
_PLACE = {p: i for i, p in enumerate(BYTE_PAIRS)}


def _explained() -> dict[str, int]:
    """Of every foreign character the pairs that explain it, as a set of bits."""
    out: dict[str, int] = {}
    for i, of in enumerate(_MAPS):
        for c in of:
            out[c] = out.get(c, 0) | 1 << i
    return out


_BITS = _explained()


def _bytes(text: str, encoding: str) -> bytes | None:
    table = _ENCODE[encoding]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _misread(char: str, encoding: str) -> str:
    table = _DECODE[encoding]
    return "".join(table[b] for b in char.encode("utf-8"))


def prior() -> np.ndarray:
    """Counts of trigrams as the letters' frequencies alone would have them, ``PRIOR`` in all: of
    words of one alphabet, at their edges, too."""
    out = np.zeros((K, K, K))
    for of in FREQUENCIES:
        p = np.zeros(K)
        for c, n in of.items():
            p[CLASS[c]] = n
        p /= p.sum()
        edge = np.zeros(K)
        edge[0] = 1.0
        out += 0.7 * np.einsum("i,j,k", p, p, p) + 0.15 * np.einsum("i,j,k", edge, p, p) + 0.15 * np.einsum("i,j,k", p, p, edge)
    return (out / out.sum() * PRIOR).ravel()


def _utf8_patterns() -> dict[str, tuple[str, str]]:
    """Garbled sequence to (restored, encoding) for every letter and sign of the repertoire."""
    out: dict[str, tuple[str, str]] = {}
    for enc in UTF8_AS:
        for c in _LETTERS + _LETTERS.upper() + SIGNS:
            if len(c.encode()) > 1 and len(c) == 1:
                out.setdefault(_misread(c, enc), (c, enc))
    # what is garbled twice
    for seq, (c, enc) in list(out.items()):
        if enc in ("cp1252", "latin_1", "cp1251"):
            for again in {enc, "cp1252"}:
                out.setdefault("".join(_misread(x, again) if ord(x) > 127 else x for x in seq), (c, enc))
    return out


def classes(word: str) -> np.ndarray:
    """Classes of a word's characters, between two edges. A word of signs alone is usual."""
    low = word.lower()
    get = CLASS.get
    if low and all(c in _SIGNS for c in low):
        return np.array([0, *[2] * len(low), 0])
    return np.array([0] + [get(c) or (1 if "0" <= c <= "9" else 2 if c in _USUAL else 3) for c in low] + [0])


def trigram_counts(texts: DataFrame, text: str) -> DataFrame:
    """(code, n) of the character trigrams of all texts; at most K**3 rows, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        total = np.zeros(K**3, np.int64)

        def flush() -> None:
            for w, n in words.items():
                c = classes(w)
                np.add.at(total, c[:-2] * K * K + c[1:-1] * K + c[2:], n)
            words.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for w in _SPLIT.findall(t or ""):
                    words[w] = words.get(w, 0) + 1
            if len(words) > 200_000:
                flush()
        flush()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])

    return texts.select(F.col(text)).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _one_script(text: str) -> bool:
    """Whether letters beyond the repertoire are of one script (kana and Chinese signs count as one)."""
    names = {unicodedata.name(c, "").split(" ")[0].split("-")[0] for c in text if c.isalpha() and c.lower() not in CLASS and c > "\u02ff"}
    return len({"CJK" if n in ("HIRAGANA", "KATAKANA") else n for n in names}) < 2


class Restorer:
    """Finds and restores garbled words under a trigram model (array of K**3 counts)."""

    def __init__(self, counts: np.ndarray) -> None:
        counts = counts + prior()
        self.logp = np.log((counts + 0.2) / counts.sum())
        cube = self.logp.reshape(K, K, K)
        for odd in (cube[3], cube[:, 3], cube[:, :, 3]):
            np.minimum(odd, ODD, out=odd)
        self.utf8 = _utf8_patterns()
        self.longest = max(map(len, self.utf8))
        self.words: dict[str, tuple[str, bool, tuple | None]] = {}
        self.read: dict[str, list[tuple[tuple[str, str], float, str]]] = {}
        leads = {_misread("\U0001f4a1", e)[:2] for e in UTF8_AS}
        self.leads = regex.compile("|".join(map(regex.escape, leads)))
        auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        pairs = counts.reshape(K, K, K).sum(2)
        for seq in {*self._telling(pairs), *leads}:
            auto.add_word(seq, 1)
        auto.add_word("�", 1)
        for seq in self._byte_patterns(pairs):
            auto.add_word(seq, 1)
        auto.make_automaton()
        self.automaton = auto
        self.runs = regex.compile("(?:" + "|".join(regex.escape(s) for s in sorted(self.utf8, key=len, reverse=True)) + ")+")

    def _telling(self, counts: np.ndarray) -> set[str]:
        """Sequences of misread UTF-8 that don't stand in proper words. A letter that looks like two
        usual letters is looked for together with the letter after it."""
        logp = np.log((counts + 0.2) / counts.sum())
        usual = lambda seq: len(seq) == 2 and all(c.lower() in CLASS for c in seq) and logp[CLASS[seq[0].lower()], CLASS[seq[1].lower()]] > np.log(RARE)
        out = {seq for seq in self.utf8 if not usual(seq)}
        for enc in UTF8_AS:
            seen = {c: _misread(c, enc) for c in _LETTERS + _LETTERS.upper() if not c.isascii() and len(c) == 1}
            plain = {c: seq for c, seq in seen.items() if usual(seq)}
            out |= {seq + seen[d] for c, seq in plain.items() for d in seen if (c.isupper() or d.islower()) and logp[CLASS[c.lower()], CLASS[d.lower()]] > np.log(SEEN)}
        return out

    def _byte_patterns(self, counts: np.ndarray) -> set[str]:
        """Garbled signs, and garbled pairs of letters that are much rarer than what they stand for;
        ``counts`` are those of pairs of characters."""
        logp = np.log((counts + 0.2) / counts.sum())
        out = {c for c in _BITS if not c.isascii() and c.lower() not in CLASS and c not in SIGNS}
        found = [np.zeros((0, 2), np.int64)]
        for of in _MAPS:
            both = [(ord(g), CLASS.get(g.lower(), 2 if g in _USUAL else 3), CLASS[c.lower()], c.isupper()) for g, c in of.items() if (g.lower() in CLASS or g in SIGNS) and c.lower() in CLASS]
            if not both:
                continue
            if any(c in ACCENTED for c in of.values()):  # their neighbours are ASCII letters
                both += [(ord(c), CLASS[c.lower()], CLASS[c.lower()], c.isupper()) for c in LATIN + LATIN.upper()]
            garbled, seen, meant, upper = (np.array(x) for x in zip(*both))
            mine, theirs = logp[meant[:, None], meant[None, :]], logp[seen[:, None], seen[None, :]].copy()
            theirs[(seen == 3)[:, None] | (seen == 3)[None, :]] = -np.inf
            hit = (mine > np.log(SEEN)) & (theirs < np.minimum(np.log(RARE), mine - 1.0)) & ~(~upper[:, None] & upper[None, :])
            i, j = np.nonzero(hit)
            same = (seen[i] == meant[i]) & (seen[j] == meant[j])
            found.append(np.column_stack((garbled[i], garbled[j]))[~same])
        return out | {chr(a) + chr(b) for a, b in np.unique(np.concatenate(found), axis=0).tolist()}

    def score(self, word: str) -> float:
        c = classes(word)
        if len(c) < 3:
            return -20.0
        p = self.logp[c[:-2] * K * K + c[1:-1] * K + c[2:]]
        return float(p.mean())

    def _utf8(self, word: str) -> str | None:
        """The word with its misread UTF-8 sequences restored; None if there is nothing to restore.

        Up to three layers are taken off, each in the likeliest way; of all layers the likeliest
        counts, an inner one with an allowance, as what is garbled twice is unlikely throughout.
        """
        best, now = (self.score(word), word), word
        for layer in range(1, 4):
            ways = set()
            for enc in UTF8_AS:
                raw = _bytes(now, enc)
                if raw is not None and any(b > 127 for b in raw):
                    try:
                        if _one_script(way := raw.decode("utf-8")):
                            ways.add(way)
                    except UnicodeDecodeError:
                        continue
            if not ways:
                ways.add(self.runs.sub(lambda m: self._run(m[0]), now))
            ways.discard(now)
            if not ways:
                break
            before, now = now, max(sorted(ways), key=self.score)
            m = self.runs.search(before)
            if m and not self._sure(m[0]) and self.score(now) < self.score(before) + DOUBT:
                break
            emoji = any(ord(c) >= 0x1F000 for c in now)
            best = max(best, (self.score(now) + 2.5 * layer + 100 * emoji, now))
        return best[1] if best[1] != word else None

    @staticmethod
    def _sure(run: str) -> bool:
        """Whether a run of misread UTF-8 holds anything but letters and signs of proper words, or a
        capital after a small letter."""
        return any(c.lower() not in CLASS and c not in "«»\xa0\xad" for c in run) or any(a.islower() and b.isupper() for a, b in zip(run, run[1:]))

    def _run(self, run: str) -> str:
        for enc in UTF8_AS:
            raw = _bytes(run, enc)
            if raw is not None:
                try:
                    return raw.decode("utf-8")
                except UnicodeDecodeError:
                    pass
        return run

    def word(self, word: str) -> tuple[str, bool, tuple | None]:
        """(word as it should be, was it garbled, by which pair of one byte encodings)."""
        got = self.words.get(word)
        if got is None:
            got = self._judge(word)
            if len(self.words) > 300_000:
                self.words.clear()
            self.words[word] = got
        return got

    def _gain(self, word: str, fixed: str) -> float:
        """Nats by which ``fixed`` is likelier as a whole."""
        return self.score(fixed) * max(1, len(fixed)) - self.score(word) * max(1, len(word))

    def _judge(self, word: str) -> tuple[str, bool, tuple | None]:
        garbled = "\ufffd" in word
        if word.isascii():
            return word, False, None
        best: tuple[float, str, tuple | None] | None = None
        m = self.runs.search(word)
        if m or self.leads.search(word):
            fixed = self._utf8(word)
            if fixed is not None and "\ufffd" not in fixed and not any(0x80 <= ord(c) < 0xA0 for c in fixed):
                sure = m is None or self._sure(m[0])
                gain = self._gain(word, fixed) - FOREIGN * sum(c.isalpha() and c.lower() not in CLASS for c in fixed)
                emoji = any(ord(c) >= 0x1F000 for c in fixed)
                # letters that may as well be proper must give a much likelier word, sign by sign
                if self.score(fixed) >= self.score(word) + (0.0 if sure else DOUBT) or (sure and gain > MARGIN) or emoji:
                    best = (max(gain, MARGIN), fixed, UTF8)
        if sum(ord(c) > 127 for c in word) >= 3:  # of fewer, the passage decides
            for pair, s, fixed in self._readings(word):
                if s > MARGIN and (best is None or s > best[0]) and self.score(fixed) > LIKELY:
                    best = (s, fixed, pair)
        if best:
            return best[1], True, best[2]
        return word, garbled, None

    def _readings(self, word: str) -> list[tuple[tuple[str, str], float, str]]:
        """(pair, nats gained, the word as read) of the pairs that explain all foreign characters of
        a word, one for each different reading."""
        got = self.read.get(word)
        if got is not None:
            return got
        bits = -1
        for c in word:
            if c > "\x7f":
                bits &= _BITS.get(c, 0)
        out: dict[str, tuple[tuple[str, str], float, str]] = {}
        while bits > 0:
            i = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            fixed = "".join(_MAPS[i].get(c, c) if c > "\x7f" else c for c in word)
            if fixed != word and fixed not in out:
                s = self._gain(word, fixed)
                # a word's capitals stand at its start or run through it
                body = "".join(c for c in fixed if c.isalpha())
                if not (body.islower() or body.isupper() or body[1:].islower()):
                    s -= 3.0
                out[fixed] = (BYTE_PAIRS[i], s, fixed)
        if len(self.read) > 100_000:
            self.read.clear()
        self.read[word] = list(out.values())
        return self.read[word]

    def _passage(self, words: list[str]) -> dict[str, tuple[str, bool, tuple]]:
        """Of words with too few foreign characters to tell by themselves, those that are garbled:
        all are read by one pair, the one whose gains and losses sum up to the most."""
        best: tuple[float, dict[str, tuple[str, bool, tuple]]] = (MARGIN, {})
        read = {w: self._readings(w) for w in dict.fromkeys(words)}
        for pair in dict.fromkeys(p for r in read.values() for p, _, _ in r):
            total, out = 0.0, {}
            for w, ways in read.items():
                fixed = self._by_pair(w, pair)
                got = next((x for x in ways if x[2] == fixed), None)
                if got is None or self.score(got[2]) <= LIKELY:
                    continue
                total += got[1]
                if got[1] > 0:
                    out[w] = (got[2], True, pair)
            if total > best[0]:
                best = (total, out)
        return best[1]

    def _by_pair(self, word: str, pair: tuple[str, str]) -> str | None:
        """The word's foreign characters as they were written; None if the pair doesn't explain them."""
        if pair == UTF8:
            fixed = self.runs.sub(lambda m: self._run(m[0]), word)
            return None if fixed == word else fixed
        of = _MAPS[_PLACE[pair]]
        if any(c > "\x7f" and c not in of for c in word):
            return None
        fixed = "".join(of.get(c, c) if c > "\x7f" else c for c in word)
        return None if fixed == word else fixed

    def _any(self, text: str, hits: list[int]) -> bool:
        """Whether any of the words that were hit is garbled, by itself or with the others."""
        flat = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        few, last = [], -1
        for end in hits:
            if end < last:
                continue
            start, last = flat.rfind(" ", 0, end + 1) + 1, flat.find(" ", end)
            last = len(flat) if last < 0 else last
            word = flat[start:last]
            if word.isascii():
                continue
            if self.word(word)[1]:
                return True
            if sum(c > "\x7f" for c in word) < 3:
                few.append(word)
        return bool(few) and bool(self._passage(few))

    def text(self, text: str | None) -> tuple[str | None, int]:
        """(restored text, number of garbled words). Only words the automaton hits are judged;
        of the others those a few places off a garbled one, by its pair."""
        if not text or text.isascii():
            return text, 0
        hits = [end for end, _ in self.automaton.iter(text)]
        if not hits or not self._any(text, hits):
            return text, 0
        words = list(_SPLIT.finditer(text))
        done: list[tuple | None] = [None] * len(words)
        h, few = 0, []
        for i, m in enumerate(words):
            while h < len(hits) and hits[h] < m.start():
                h += 1
            if h < len(hits) and hits[h] < m.end():
                got = self.word(m[0])
                done[i] = got if got[1] else None
                if not got[1] and not m[0].isascii():
                    few.append(i)
        # those with one or two foreign characters are judged together
        few = [i for i in few if sum(ord(c) > 127 for c in words[i][0]) < 3]
        together = self._passage([words[i][0] for i in few]) if few else {}
        for i in few:
            done[i] = together.get(words[i][0])
        # words that don't tell by themselves go with a garbled word a few places off
        for step in (1, -1):
            pair, far = None, 0
            for i in range(len(words))[::step]:
                if done[i]:
                    pair, far = done[i][2] or pair, 0
                    continue
                far += 1
                if pair is None or far > NEAR or words[i][0].isascii():
                    continue
                fixed = self._by_pair(words[i][0], pair)
                if fixed and self.score(fixed) > self.score(words[i][0]) + (0 if pair == UTF8 else 1):
                    done[i] = (fixed, True, pair)
                    far = 0
        out, last, found = [], 0, 0
        for m, got in zip(words, done):
            if got:
                found += 1
                out += [text[last : m.start()], got[0]]
                last = m.end()
        out.append(text[last:])
        return "".join(out), found


def model_counts(docs: DataFrame, text: str) -> np.ndarray:
    counts = np.zeros(K**3, np.int64)
    for r in trigram_counts(docs, text).toLocalIterator():  # at most K**3 rows
        counts[r["code"]] = r["n"]
    return counts


def restore(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, restored string, n_garbled bigint of every row; n_garbled 0 and the text itself where
    nothing is wrong.

    Null and empty texts stay as they are; what a replacement character stands for is lost, so
    such words count as garbled and stay. Texts of any length are read whole; every row gives one
    row, repeated keys too; other columns are ignored.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model_counts(docs, text))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(spread.value)
        for batch in batches:
            done = [restorer.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["k", "restored", "n"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, restored string, n bigint")
    return out.withColumnsRenamed({"k": key, "n": "n_garbled"})
