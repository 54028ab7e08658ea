"""Garbled text from a wrong character encoding, found through the corpus' own clean words.

Every distinct word with a non-ASCII character is garbled under all encoding chains; the garbled
forms are hash-joined with the words that documents hold. A hit counts only if its original is
verified: the original is itself a word of the corpus, not a garbled one, and the direction is
certain - a chain through UTF-8 or with lost characters cannot run the other way, and for two
8-bit encodings the original must stand in far more different texts, or several words of one text
must agree on a chain that turns plain words into odd ones. Words seen only once get a second chance
through their non-ASCII runs, which are units of the same table for chains through UTF-8.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

# Python codec names of the encodings texts are written in and mistaken for.
SINGLE_BYTE = (
    "cp1252", "latin_1", "iso8859_15", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp852", "mac_latin2",
    "cp1251", "koi8_r", "koi8_u", "cp866", "iso8859_5", "mac_cyrillic", "cp1253", "iso8859_7", "cp737", "cp1254", "cp1257",
)
MULTI_BYTE = ("cp932", "euc_jp", "gbk", "big5", "cp949")
LOST = "�"
MORE_FREQUENT = 3
HELD_CHARS = 8_000_000
UNITS_PER_TASK = 20_000

UNITS = "doc_id bigint, text_id bigint, unit string, is_run boolean, side string, hunk int"
FORMS = "form string, original string, chain string, certain boolean"
VOTES = "form string, original string, chain string, vote int"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct units of each document, with where they stand: an added or removed line of a hunk, or elsewhere."""
    word = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+")
    run = re.compile(r"[\u0080-\U0010ffff]+")
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if text is None or text.isascii():
                continue
            seen, hunk, inside = set(), 0, False
            for line in text.split("\n"):
                if line.startswith("@@"):
                    hunk, inside = hunk + 1, True
                elif line.startswith("diff --git "):
                    inside = False
                if line.isascii():
                    continue
                side = {"-": "removed", "+": "added"}.get(line[:1], "open") if inside else "open"
                where = (side, hunk if side != "open" else 0)
                for w in word.findall(line):
                    if w.isascii():
                        continue
                    seen.add((w, False, *where))
                    runs = run.findall(w)
                    if runs[0] != w:
                        seen.update((r, True, *where) for r in runs)
            out.extend((doc_id, text_id, *x) for x in seen)
        cols = list(zip(*out)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int32()))], ["doc_id", "text_id", "unit", "is_run", "side", "hunk"])


def text_units(documents: DataFrame) -> DataFrame:
    """UNITS of every whole text: words with a non-ASCII character and, where ASCII letters touch them,
    their non-ASCII runs. Copies of a text share its ``text_id``. Null, empty and ASCII texts have none."""
    return documents.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), F.col("text")).mapInArrow(_units, UNITS)


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct characters of a task's units."""
    seen: set[str] = set()
    for batch in batches:
        seen.update(*batch.column(0).to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["c"])


def _garble(single: tuple[str, ...], multi: tuple[str, ...], lost: str, alphabet: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        possible = frozenset(alphabet).issuperset if alphabet is not None else lambda form: True
        tables = {}
        for e in single:  # what each byte becomes: passed through, lost, or dropped where the encoding has no character
            known = [bytes([b]).decode(e, "ignore") for b in range(256)]
            tables[e] = [{b: k or x for b, (k, x) in enumerate(zip(known, each))} for each in (map(chr, range(256)), [lost] * 256)] + [{b: k for b, k in enumerate(known)}]

        def read(raw: bytes) -> Iterator[tuple[str, str, bool]]:
            """(text, encoding, whether a byte was dropped) for every wrong way of reading the bytes."""
            flat = raw.decode("latin_1")
            for e, (passed, holed, dropped) in tables.items():
                yield flat.translate(passed), e, False
                holes = flat.translate(holed)
                if lost in holes:
                    yield holes, e, False
                    yield flat.translate(dropped), e, True
            for e in multi:
                yield raw.decode(e, "replace"), e, False
            yield raw.decode("utf_8", "replace"), "utf_8", False
            yield raw.decode("ascii", "replace"), "ascii", False

        def chains(unit: str) -> Iterator[tuple[str, str, bool]]:
            """(form, chain, certain) for all chains; several may lead to the same form."""
            for once, e, dropped in read(unit.encode("utf_8", "surrogatepass")):
                yield once, f"utf_8>{e}", not dropped
                if lost in once or dropped or e not in tables:
                    continue
                for twice, e2, dropped2 in read(once.encode("utf_8")):
                    yield twice, f"utf_8>{e},utf_8>{e2}", not dropped2
            for a in (*single, *multi):
                try:
                    raw = unit.encode(a)
                except UnicodeEncodeError:
                    continue
                for once, e, _ in read(raw):
                    if e != a:
                        yield once, f"{a}>{e}", lost in once

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.bool_()))], ["form", "original", "chain", "certain"])

        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for unit, is_run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: set[str] = set()
                for form, chain, certain in chains(unit):
                    if form in seen:
                        continue
                    seen.add(form)
                    held += len(form)
                    if form != unit and form and not form.isascii() and not (is_run and not certain) and possible(form):
                        rows.append((form, unit, chain, certain))
                        held += len(unit)
                    if held > HELD_CHARS:  # a long unit's forms go out in parts; one that comes again is only a repeated pair
                        yield packed(rows)
                        rows, seen, held = [], set(), 0
            yield packed(rows)

    return run


def garbled_forms(vocabulary: DataFrame, alphabet: str | None = None) -> DataFrame:
    """FORMS of each (unit, is_run): all ways one or two wrong readings turn it into other non-ASCII text, those left out that
    hold a character which isn't in the ``alphabet``, if it is given. ``certain``: the form can't be somebody's original and the unit its garbled form."""
    return vocabulary.select("unit", "is_run").mapInArrow(_garble(SINGLE_BYTE, MULTI_BYTE, LOST, alphabet), FORMS)


def _oddness(word: str) -> int:
    """Places where a word looks misread: a symbol between letters, a capital after a small letter, or
    another script, one of both characters not being ASCII."""
    kinds = [unicodedata.category(c) for c in word]
    scripts = [unicodedata.name(c, "").partition(" ")[0] for c in word]
    odd = 0
    for i in range(1, len(word)):
        if word[i - 1 : i + 1].isascii():
            continue
        if kinds[i - 1][0] == kinds[i][0] == "L":
            odd += (kinds[i - 1] == "Ll" and kinds[i] == "Lu") or (scripts[i - 1] != scripts[i] and {scripts[i - 1], scripts[i]} <= {"LATIN", "CYRILLIC", "GREEK"})
        elif i + 1 < len(word) and (kinds[i][0] in "SC" or kinds[i] == "No") and kinds[i - 1][0] == kinds[i + 1][0] == "L":
            odd += 1
    return odd


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """VOTES: each chain of two 8-bit encodings that leads from an original to a form, with 1 where the form is the
    odd one of both or in far fewer texts, -1 where the original is, else 0."""
    encodings = (*SINGLE_BYTE, *MULTI_BYTE)
    for batch in batches:
        out = []
        for form, original, form_texts, original_texts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            plain = all(unicodedata.category(c)[0] in "LMN" or c == "_" for c in original)
            a, b = _oddness(form), _oddness(original)
            against = b > a or form_texts >= MORE_FREQUENT * original_texts
            vote = -1 if against else 1 if a > b or original_texts >= MORE_FREQUENT * form_texts else 0
            if not plain and vote >= 0:
                continue
            for x in encodings:
                try:
                    raw = original.encode(x)
                except UnicodeEncodeError:
                    continue
                for y in encodings:
                    if y != x and raw.decode(y, "ignore") == form:
                        out.append((form, original, f"{x}>{y}", vote))
        cols = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()))], ["form", "original", "chain", "vote"])


def agreed_pairs(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """(form, original) of two 8-bit encodings whose direction a text settles: two or more of its words can
    come from plain words by the same chain, one at least is odd or rare beside its original and none the other way round."""
    votes = pairs.where("not certain and length(form) >= 2").select("form", "original", "form_texts", "original_texts").mapInArrow(_votes, VOTES)
    votes = Scratch(units.sparkSession).write(votes, "votes")
    # Texts matter once however many copies they have, and only if one of their words has a pair without a vote against it.
    may = votes.where("vote >= 0").select(F.col("form").alias("unit")).distinct()
    stands = units.where("not is_run").select("text_id", "unit").distinct()
    texts = stands.join(may, "unit", "left_semi").groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_id")
    said = stands.join(texts, "text_id", "left_semi").join(votes.withColumnRenamed("form", "unit"), "unit")
    # A word that several originals could have become speaks for the chain if any of them does.
    words = said.groupBy("text_id", "chain", "unit").agg(F.max("vote").alias("vote"))
    agreed = words.groupBy("text_id", "chain").agg(F.count_if(F.col("vote") >= 0).alias("n"), F.max("vote").alias("most"), F.min("vote").alias("least")).where("n > 1 and most = 1 and least >= 0")
    return said.where("vote >= 0").join(agreed.select("text_id", "chain"), ["text_id", "chain"], "left_semi").select(F.col("unit").alias("form"), "original").distinct()


def verified_pairs(units: DataFrame) -> DataFrame:
    """Garbled units of the corpus (form) with each verified original, its chain and how many different texts hold it.

    Units of any length are garbled; forms of long ones leave their task in parts of HELD_CHARS characters.
    A unit becomes hundreds of forms, so the number of tasks follows the units counted, not their bytes.
    """
    spark = units.sparkSession
    scratch = Scratch(spark)
    vocabulary = scratch.write(units.groupBy("unit").agg(F.count_distinct("text_id").alias("n_texts"), F.min("is_run").alias("is_run")), "vocabulary")
    clean = vocabulary.where(~F.contains("unit", F.lit(LOST)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vocabulary.count() // UNITS_PER_TASK))
    # A form with a character that no unit has is no unit's; the characters are at most as many as Unicode has.
    alphabet = "".join(r.c for r in vocabulary.select("unit").mapInArrow(_characters, "c string").distinct().collect())
    forms = garbled_forms(clean.repartition(tasks, "unit"), alphabet)
    held = vocabulary.select(F.col("unit").alias("form"), F.col("n_texts").alias("form_texts"))
    origin = vocabulary.select(F.col("unit").alias("original"), F.col("n_texts").alias("original_texts"))
    pairs = scratch.write(forms.join(held, "form").join(origin, "original"), "candidates")
    frequent = (F.col("original_texts") >= MORE_FREQUENT * F.col("form_texts")) & (F.length("form") >= 2)
    alone = (F.col("certain") & (F.contains("form", F.lit(LOST)) | (F.length("form") >= 2))) | frequent
    known = pairs.where(alone)
    agreed = scratch.write(agreed_pairs(units, pairs), "agreed")
    # What is settled by itself, or the other way round by another text, isn't settled by agreement.
    reverse = known.select("form", "original").union(agreed).select(F.col("original").alias("form"), F.col("form").alias("original")).distinct()
    new = pairs.where(~alone).join(agreed, ["form", "original"], "left_semi").join(reverse, ["form", "original"], "left_anti")
    return known.unionByName(new.select(*known.columns))


def best_originals(pairs: DataFrame) -> DataFrame:
    """One verified original per garbled unit; a unit that is itself garbled is nobody's original."""
    garbled = pairs.select(F.col("form").alias("original")).distinct()
    verified = pairs.join(garbled, "original", "left_anti")
    best = F.max_by(F.struct("original", "chain"), F.struct("original_texts", F.xxhash64("original")))
    return verified.groupBy("form").agg(best.alias("b")).select(F.col("form").alias("unit"), "b.original", "b.chain")


def garbled_units(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units of the documents, all verified pairs, the best original of each garbled unit), written to the shared scratch folder."""
    scratch = Scratch(documents.sparkSession)
    units = scratch.write(text_units(documents), "units")
    pairs = scratch.write(verified_pairs(units), "pairs")
    return units, pairs, scratch.write(best_originals(pairs), "originals")


def garbled_hits(units: DataFrame, pairs: DataFrame, originals: DataFrame) -> DataFrame:
    """Garbled units where they stand (doc_id, unit, side, hunk, original, chain), but for those on a
    removed line whose right form - any original the unit can have - is added in the same hunk."""
    hits = units.join(originals, "unit")
    added = units.where("side = 'added'").select("doc_id", "hunk", F.col("unit").alias("original")).distinct()
    removed = hits.where("side = 'removed'")
    possible = removed.select("doc_id", "hunk", "unit").distinct().join(pairs.select(F.col("form").alias("unit"), "original"), "unit")
    mended = possible.join(added, ["doc_id", "hunk", "original"]).select("doc_id", "hunk", "unit").distinct()
    return hits.where("side <> 'removed'").unionByName(removed.join(mended, ["doc_id", "hunk", "unit"], "left_anti").select(*hits.columns))


def garbled_documents(documents: DataFrame) -> DataFrame:
    """doc_id and number of garbled units of each document with a garbled passage."""
    units, pairs, originals = garbled_units(documents)
    return garbled_hits(units, pairs, originals).groupBy("doc_id").agg(F.count_distinct("unit").alias("n_units"))


RESTORED = "doc_id bigint, restored string, n_replaced int, n_lost int"


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+")
    run = re.compile(r"[\u0080-\U0010ffff]+")
    for batch in batches:
        out = []
        for doc_id, text, hits in zip(*(batch.column(i).to_pylist() for i in range(3))):
            fixes: dict[tuple, dict[str, str]] = {}
            for h in hits:
                fixes.setdefault((h["side"], h["hunk"]), {})[h["unit"]] = h["original"]
            hunk, inside, n, lines = 0, False, 0, []
            for line in text.split("\n"):
                if line.startswith("@@"):
                    hunk, inside = hunk + 1, True
                elif line.startswith("diff --git "):
                    inside = False
                side = {"-": "removed", "+": "added"}.get(line[:1], "open") if inside else "open"
                own = fixes.get((side, hunk if side != "open" else 0))
                if own and not line.isascii():

                    def mend_run(m: re.Match) -> str:
                        nonlocal n
                        if LOST in m[0] or m[0] not in own:  # lost characters are known only from the whole word
                            return m[0]
                        n += 1
                        return own[m[0]]

                    def mend(m: re.Match) -> str:
                        nonlocal n
                        if m[0] in own and (LOST not in m[0] or m[0].strip(LOST)):
                            n += 1
                            return own[m[0]]
                        return run.sub(mend_run, m[0])

                    line = word.sub(mend, line)
                lines.append(line)
            restored = "\n".join(lines)
            out.append((doc_id, restored, n, restored.count(LOST)))
        cols = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "restored", "n_replaced", "n_lost"])


def restored_documents(documents: DataFrame) -> DataFrame:
    """RESTORED text of each garbled document; ``n_lost`` characters could not be given back.

    Words are replaced by their verified original, or else their garbled runs are; a word of nothing but
    lost characters stays as it is. Texts without a doc_id are left out. Passages shown garbled on purpose (see :func:`garbled_hits`) stay too.
    """
    units, pairs, originals = garbled_units(documents)
    hits = garbled_hits(units, pairs, originals).groupBy("doc_id").agg(F.collect_set(F.struct("unit", "original", "side", "hunk")).alias("hits"))
    texts = documents.select(F.col("doc_id").cast("bigint"), "text").where("text is not null")
    return texts.join(hits, "doc_id").select("doc_id", "text", "hits").mapInArrow(_restore, RESTORED)


def checks(documents: DataFrame, restored: DataFrame) -> DataFrame:
    """(check, holds) of RESTORED rows against the texts they come from: each document once, texts changed only where something was
    replaced, as many lines as before, lines of ASCII untouched, and lost characters counted. All hold for an empty result."""
    both = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(restored, "doc_id")
    lines = lambda c: F.split(c, "\n")
    was = F.zip_with(lines("text"), lines("restored"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.forall(was, lambda x: ~x["a"].rlike(r"\A[\x00-\x7f]*\z") | (x["a"] == x["b"]))
    lost = F.length("restored") - F.length(F.replace("restored", F.lit(LOST), F.lit("")))
    held = {
        "one_row_each": F.count(F.lit(1)) == F.count_distinct("doc_id"), "changed_only_where_replaced": F.every((F.col("n_replaced") > 0) | (F.col("text") == F.col("restored"))),
        "lines_kept": F.every(F.size(lines("text")) == F.size(lines("restored"))), "ascii_lines_kept": F.every(kept), "lost_counted": F.every(lost == F.col("n_lost")),
    }
    row = both.agg(*(F.coalesce(v, F.lit(True)).alias(k) for k, v in held.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("holds")) for k in held))).alias("x")).select("x.*")
