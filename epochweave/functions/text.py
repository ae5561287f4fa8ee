"""Text: cleaning, tokenizing, and turning documents into training rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUNCTUATION = r"[!-/:-@\[-`{-~\p{P}]"
#: Tokens that are cut into pieces together: their numbers and places take some 60 bytes each.
AT_ONCE = 1 << 17
#: The ranges of ideographs that are each a token.
IDEOGRAPHS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"


def clean(c: Column) -> Column:
    """Without control characters; any white space is a blank."""
    return F.regexp_replace(F.regexp_replace(c, r"[\t\n\r\p{Zs}]", " "), r"[\x{0}\x{FFFD}\p{Cc}\p{Cf}]", "")


def apart(c: Column) -> Column:
    """Ideographs with blanks around them."""
    return F.regexp_replace(c, f"(?=[\\x{{3400}}-\\x{{2FA1F}}])({IDEOGRAPHS})", " $1 ")  # one comparison rules out most characters


@lru_cache(maxsize=1)
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """From Python's own tables: characters with one character left without marks, and these; marks, which go, come last. Then those with several left."""
    one, several, gone = {}, {}, []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]):
        left = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if not left:
            gone.append(c)
        elif len(left) > 1:
            several[c] = left
        elif left != c:
            one[c] = left
    return "".join(one) + "".join(gone), "".join(one.values()), several


def without_accents(c: Column) -> Column:
    """Decomposed, without combining marks: characters that leave one character are translated; texts with such as leave more (syllables in blocks, mostly) go character by character."""
    find, put, several = _decomposed()
    blocks = [x for x in several if "\uac00" <= x <= "\ud7a3"]
    rest = {k: v for k, v in several.items() if k not in set(blocks)}
    short = [x for x in blocks if len(several[x]) == 2]
    order = "".join([x for x in blocks if len(several[x]) == 3] + short)  # without a third part they come last, and have nothing to be put in their place
    part = lambda x, i: F.translate(x, order, "".join(several[k][i] for k in order if len(several[k]) > i))
    others = F.create_map(*[F.lit(x) for kv in rest.items() for x in kv])
    odd = f"[\uac00-\ud7a3{''.join(rest)}]"
    one = lambda x: F.when(x.between("\uac00", "\ud7a3"), F.concat(part(x, 0), part(x, 1), part(x, 2))).otherwise(F.coalesce(F.element_at(others, x), x))
    wide = F.when(c.rlike(odd), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.translate(wide, find, put)).otherwise(c)


def basic_tokens(c: Column, accents: bool = True, keep: list[str] | None = None) -> Column:
    """Cleaned, lower-cased words, with each punctuation mark a token. accents: keep them. keep: words that stay as they are."""
    words = apart(clean(c))
    plain = lambda x: F.lower(x) if accents else without_accents(F.lower(x))
    of = lambda x: F.filter(F.split(F.regexp_replace(x, f"({PUNCTUATION})", " $1 "), " +"), lambda t: t != "")
    if not keep:
        return of(plain(words))
    kept = F.array(*map(F.lit, keep))
    return F.flatten(F.transform(F.filter(F.split(words, " +"), lambda t: t != ""), lambda t: F.when(F.array_contains(kept, t), F.array(t)).otherwise(of(plain(t)))))


def sentence_lines(c: Column) -> Column:
    """basic_tokens() of each sentence, as a text with blanks between and around them; white space behind a full stop ends a sentence.

    Patterns go once over a whole text, in which a character that texts lose marks the ends. They look first at what rules out most characters.
    """
    marked = F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit("\x01")), r"\s(?<=\.\s)", "\x00")  # both are control characters, which go
    plain = F.regexp_replace(F.regexp_replace(marked, r"(?![ -~])[\t\n\r\p{Zs}]", " "), r"(?![ -~])[\x{FFFD}\p{Cc}\p{Cf}&&[^\x{0}]]", "")
    return F.split(F.regexp_replace(F.lower(apart(plain)), f"(?![a-z ])({PUNCTUATION})", " $1 "), "\x00")


class Pieces:
    """A vocabulary as two trees of characters (beginnings of words, and what may follow), for cutting words into longest pieces in one pass.

    Where a node's characters can't go on, the pieces that the longest-first rule cuts off them are known beforehand (`cut`), and what is
    left of them is another node (`back`), so that no character is looked at twice.
    """

    def __init__(self, vocabulary: Iterable[str], mark: str = "##") -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        ends: dict[int, str] = {}
        for piece in vocabulary:
            for root, text in [(0, piece)] + [(1, piece[len(mark) :])] * piece.startswith(mark):
                node = root
                for c in text:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                    node = self.next[node][c]
                if node > 1:
                    ends[node] = piece
        self.cut: list[list[str]] = [[] for _ in self.next]
        self.back: list[int | None] = [None] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, child in self.next[node].items():
                    below.append(child)
                    if child in ends:
                        self.cut[child], self.back[child] = [ends[child]], 1
                        continue
                    cut, at = list(self.cut[node]), self.back[node]
                    while at is not None and c not in self.next[at]:
                        cut, at = cut + self.cut[at], self.back[at]
                    if at is not None:
                        self.cut[child], self.back[child] = cut, self.next[at][c]
            level = below

    def split(self, word: str) -> list[str] | None:
        """The pieces, or None if it can't be cut."""
        out, node = [], 0
        for c in word:
            while c not in self.next[node]:
                out += self.cut[node]
                if (node := self.back[node]) is None:
                    return None
            node = self.next[node][c]
        while node != 1:
            out += self.cut[node]
            if (node := self.back[node]) is None:
                return None
        return out


def wordpieces(tokens: Column, vocabulary: Iterable[str], unknown: str = "[UNK]", most: int = 200) -> Column:
    """Each token as the longest pieces of the vocabulary, later ones behind ##; unknown if it can't be or is too long.

    The vocabulary goes to every task with the function; it is bounded like any tokenizer's. Rows of about AT_ONCE tokens are handled together, and
    their distinct tokens cut once each.
    """
    vocabulary, at_once = tuple(vocabulary), AT_ONCE

    def cut(pieces: Pieces, column: pa.ListArray) -> pa.ListArray:
        of = column.flatten().dictionary_encode()  # what null rows hide isn't in it
        cut = [(pieces.split(w) if 0 < len(w) <= most else None) or [unknown] for w in of.dictionary.to_pylist()]
        each = np.array([len(c) for c in cut], np.int64)
        begins = np.concatenate([[0], np.cumsum(each)])
        which = of.indices.to_numpy(zero_copy_only=False)
        n = each[which] if len(cut) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(begins[which] - total[:-1], n) + np.arange(total[-1]) if len(cut) else np.zeros(0, np.int64)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        rows = total[np.concatenate([[0], np.cumsum(sizes)])]
        values = pa.array([p for c in cut for p in c], pa.string()).take(pa.array(take))
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), values, mask=column.is_null())

    @F.arrow_udf("array<string>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces(vocabulary)
        for column in columns:
            before = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = np.flatnonzero(np.diff(before // at_once, prepend=0)).tolist()  # rows that reach into the next part
            parts = [cut(pieces, column.slice(x, y - x)) for x, y in zip([0, *at], [*at, len(column)], strict=True) if y > x]
            yield pa.concat_arrays(parts) if parts else cut(pieces, column)

    return run(tokens)


def cut_or_fill(tokens: Column, length: int, fill: str = "[PAD]") -> Column:
    """Exactly `length` tokens."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(fill), length)), 1, length)


def scattered_labels(positions: Column, labels: Column, length: int, ignore: int = -100) -> Column:
    """An array of `length` with the labels at their positions (the last, where one repeats), else `ignore`."""
    at = lambda i: F.array_max(F.filter(F.sequence(F.lit(1), F.size(positions)), lambda k: F.element_at(positions, k) == i))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.get(labels, at(i) - 1), F.lit(ignore)))


def stripped_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line that isn't blank, without outer white space."""
    lines = docs.withColumn("line", F.explode(F.split(text, "\n"))).withColumn("line", F.regexp_replace(F.regexp_replace("line", r"^\s+", ""), r"\s+$", ""))
    return lines.where("line <> ''")


def paragraphs(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """Lines that aren't blank with part: how many blank ones came before. A blank line begins another document."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("part", F.sum((F.trim(line) == "").cast("long")).over(w)).where(F.trim(line) != "")


def masked_count(n: Column, share: float, most: int) -> Column:
    """How many of n tokens are predicted."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.round(n * share).cast("int")))
