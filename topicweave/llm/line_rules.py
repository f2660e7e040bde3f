"""Quality rules, line first.

Each line of a text is judged by itself: it fails as navigation (bars between its items, or nothing
but menu words), as boilerplate (a fixed phrase), or for want of punctuation: no mark at its end and
no sentence that ends inside it. Failing lines are removed. A document is rejected when it fails the base rules (too few words, too many
words in repeated triples) or when the removed lines held more than ``LOSS`` of its words.

Defined results: null and empty texts have no words, lose nothing and are rejected by the base rules;
lines without a word are neither judged nor counted, and are removed; repeated rows are judged alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topicweave.llm import textbytes as tb

MIN_WORDS = 50
MAX_REPEATED = 0.5  # share of the words that stand in repeated triples
LOSS = 0.5  # share of the words that failing lines may hold
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
# patterns of failing lines, over a line without its outer blanks
NAVIGATION = r"\|.*\||^((home|menu|login|log in|logout|sign in|sign up|register|search|next|previous|back|top|share|print|contact|about|help|faq|sitemap)[ /|>.,-]*)+$"
BOILERPLATE = r"all rights reserved|terms of (use|service)|privacy policy|cookie policy|(use|accept|allow) (all )?cookies|enable javascript|lorem ipsum|subscribe to (our|the)|click here to|powered by|licensed under|permission is hereby granted"
ENDS = ".!?:;\"')…»”’"


class LineJudge:
    def __init__(self):
        self.bad = re.compile(f"({NAVIGATION})|({BOILERPLATE})".encode(), re.IGNORECASE)
        # in bytes: one of the ASCII marks, or one of the others as a byte sequence
        self.ended = re.compile(b"(?:" + b"|".join(re.escape(c.encode()) for c in ENDS) + b")$|[.!?] ")

    def fails(self, line: bytes) -> bool:
        return bool(self.bad.search(line)) or not self.ended.search(line)

    def clean(self, raw: bytes) -> tuple[list[bytes], int, int]:
        """Kept lines, words in removed lines, and lines equal to an earlier one."""
        kept, lost, repeated, seen = [], 0, 0, set()
        for line in raw.split(b"\n"):
            words = len(line.split())  # bytes are split at the six blanks of the word rule
            if not words:
                continue
            repeated += line in seen
            seen.add(line)
            if self.fails(line.strip(BLANKS)):
                lost += words
            else:
                kept.append(line)
        return kept, lost, repeated


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words, characters in words, symbols, words in triples found twice or more."""
    docs = len(offsets) - 1
    solid = ~tb.space_table()[data]

    def per_doc(mask: np.ndarray) -> np.ndarray:
        run = np.append(0, np.cumsum(mask))
        return run[offsets[1:]] - run[offsets[:-1]]

    starts, ends = tb.runs(solid, offsets)
    doc = tb.owner(starts, offsets)
    at = tb.pairs_within(doc, 3)
    covered = np.zeros(len(doc) + 2, bool)
    if len(at):
        h = tb.triple_hash(tb.span_hash(tb.prefix_hash(data), starts, ends), at)
        order = np.lexsort((h, doc[at]))
        same = (h[order][1:] == h[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        twice = at[order][np.append(same, False) | np.append(False, same)]
        for k in range(3):
            covered[twice + k] = True
    return (np.bincount(doc, minlength=docs), per_doc(solid & (data & 0xC0 != 0x80)), per_doc(tb.byte_table(SYMBOLS)[data]),
            np.bincount(doc[covered[: len(doc)]], minlength=docs))


def judge_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words,
    kept[, cleaned]) of every row; ``cleaned`` is the text of the lines that pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = LineJudge()
        for b in batches:
            for row, data, offs in tb.text_slices(b.column(1)):
                words, chars, symbols, repeat = base_counts(data, offs)
                raw, cut = data.tobytes(), offs.tolist()
                lines = [judge.clean(raw[x:y]) for x, y in zip(cut, cut[1:])]
                lost = np.array([x[1] for x in lines])
                failed = (words < MIN_WORDS) | (repeat > MAX_REPEATED * words)
                cols = [b.column(0).slice(row, len(lines))] + [pa.array(x.astype(np.int64)) for x in (words, chars, symbols, np.array([x[2] for x in lines]), repeat)]
                cols += [pa.array(failed), pa.array(lost.astype(np.int64)), pa.array(~failed & (lost <= LOSS * words))]
                if with_text:
                    cols.append(pa.array([b"\n".join(x[0]).decode() for x in lines], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names + ["cleaned"] * with_text)

    schema = f"id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_lost_words bigint, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", cleaned string" * with_text)


_WORD = r"[^\x20\x09-\x0D]+"
RULES_SQL = f"""
with words as (
  select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '{_WORD}'), 1) as pos
  from documents
), triples as (
  select doc_id, pos, w, lead(w, 1) over p as w2, lead(w, 2) over p as w3 from words window p as (partition by doc_id order by pos)
), found as (
  select doc_id, pos, count(*) over (partition by doc_id, w, w2, w3) as n from triples where w3 is not null
), covered as (
  select doc_id, count(distinct pos + k) as n_repeat_words from found, (values (0), (1), (2)) t(k) where n > 1 group by doc_id
), lines as (
  select doc_id, line, len(regexp_extract_all(line, '{_WORD}')) as n, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') as bare
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)
), judged as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines,
    sum(case when regexp_matches(bare, '{NAVIGATION}', 'i') or regexp_matches(bare, '{BOILERPLATE}', 'i') or not regexp_matches(bare, '[{ENDS.replace("'", "''")}]$|[.!?] ') then n else 0 end) as lost
  from lines where n > 0 group by doc_id
), base as (
  select d.doc_id, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as n_words,
    length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(j.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words, coalesce(j.lost, 0)::bigint as n_lost_words
  from documents d left join judged j using (doc_id) left join covered c using (doc_id)
), verdict as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from base
)
select *, not base_failed and 2 * n_lost_words <= n_words as kept from verdict
"""
