"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import report, score, segments, verify
from veilspan.operators.detect import detect, explode_findings
from veilspan.operators.model import ModelHook, with_model
from veilspan.operators.names import person_findings
from veilspan.operators.pattern_table import detect_with_table
from veilspan.operators.redact import redact, redact_one
from veilspan.operators.resolve import clip_overlaps, dedupe, drop_contained, merge_same_entity, overlapping_entities
from veilspan.operators.verdict_store import VerdictStore
from veilspan.plans import derived
from veilspan.plans.derived import customer_names, documents, letters, notes, table
from veilspan.plans.scan import check, file_documents, scan
from veilspan.policy import DEFAULT_POLICY, custom, custom_batch, mask_with
from veilspan.recognizers import DEFAULT_RECOGNIZERS, ENTITIES, RecognizerSet
from veilspan.session import dealt, materialise, remove_folders, work_folder
from veilspan.sources import manifest, tree, versions
from veilspan.sources.files import (
    coverage,
    decode,
    file_kind,
    had_crlf,
    is_repository,
    is_text_path,
    path_problem,
    source_encoding,
)
from veilspan.sources.ranges import units_of_files
from veilspan.sources.pages import assemble_pages, assemble_segments, page_blocks
from veilspan.sources.tables import as_documents, only_language, union_documents
from veilspan.streaming.scrub import start_scrub

Query = Callable[[SparkSession, str], DataFrame]

# User-defined recognizers for the overlap queries: capitalised word pairs, and
# words before punctuation, which meet at the word they share.
PAIR = r"[A-Z][a-z]+ [a-z]+"
TRIPLE = r"[a-z]+ [a-z]+ [a-z]+[.]"
STOP_WORD = r"[a-z]+[,.]"
MAIL_HOST = r"@[a-zA-Z0-9.-]+"
HEX_TOKEN = r"[0-9a-f]{16,}"


def find(entity: str, source: Query, recognizers: RecognizerSet = DEFAULT_RECOGNIZERS) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return explode_findings(detect(source(spark, sf_dir), recognizers=recognizers.only([entity])), "doc_id")

    return query


def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    p = table(spark, sf_dir, "pages")
    c = table(spark, sf_dir, "conversations")
    parts = union_documents(
        as_documents(d, "documents", F.col("doc_id"), F.col("text")),
        as_documents(p, "pages", F.col("page_id"), F.col("html")),
        as_documents(c, "conversations", F.concat_ws(":", "conv_id", "turn"), F.col("text")),
    )
    return dealt(parts, "doc_key")


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_findings(detect(documents(spark, sf_dir)), "doc_id")


def findings_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"])
    return explode_findings(detect(documents(spark, sf_dir), recognizers=chosen), "doc_id")


def findings_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS"]).with_recognizer("HEX_TOKEN", HEX_TOKEN, 0.5, "hex_token")
    return explode_findings(detect(documents(spark, sf_dir), recognizers=own), "doc_id")


def findings_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the pattern that made them, from the recognizer table."""
    rules = DEFAULT_RECOGNIZERS.to_df(spark).select("pattern_name", "regex")
    found = findings_allow_list(spark, sf_dir)
    # The recognizer table has one row per pattern of this program, so it is tiny.
    return found.join(F.broadcast(rules), "pattern_name").select(
        "doc_id", "entity", "pattern_name", "regex", "start", "end", "score"
    )


def findings_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognizer for every customer, from a table of them, beside the default ones."""
    users = table(spark, sf_dir, "customer").selectExpr(
        "'ACCOUNT' as entity", "concat('account_', c_custkey) as pattern_name", "concat('\\\\bu', c_custkey, '@mail[.]example[.](?:com|org)') as regex", "0.7d as score"
    )
    known = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS", "US_SSN"])
    return explode_findings(detect_with_table(notes(spark, sf_dir), users, known), "doc_id")


def find_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return person_findings(letters(spark, sf_dir), customer_names(spark, sf_dir), "doc_id")


def score_recognizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the ten patterns, as written, on the notes."""
    found = explode_findings(detect(notes(spark, sf_dir)), "doc_id")
    return score.scores(found, derived.true_spans(spark, sf_dir), "doc_id")


def score_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for what is left when overlaps are settled and passwords are asked for all their classes."""
    precise = DEFAULT_RECOGNIZERS.with_scope("token")
    raw = detect(notes(spark, sf_dir), recognizers=precise)
    settled = raw.withColumn("settled", clip_overlaps(drop_contained(F.col("raw"))))
    return score.scores(explode_findings(settled, "doc_id", column="settled"), derived.true_spans(spark, sf_dir), "doc_id")


def load_stand_in():
    """A stand-in for a model: names with offsets in bytes, and with the word before them once more."""
    import re

    pattern, wide = re.compile(rb"Customer#\d+"), re.compile(rb"Contact Customer#")

    def model(texts):
        found = []
        for data in (text.encode() for text in texts):
            names = [(m.start(), m.end(), "PER", 0.9) for m in pattern.finditer(data)]
            found.append(names + [(m.start(), m.end(), "PER") for m in wide.finditer(data)] + [(0, 5, "TITLE")])
        return found

    return model


STAND_IN = ModelHook("stand_in", load_stand_in, {"PER": "PERSON"}, byte_offsets=True)


def findings_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the patterns and of a model, before overlaps are settled."""
    detected = with_model(detect(derived.accented_notes(spark, sf_dir)), STAND_IN)
    return explode_findings(detected, "doc_id").drop("priority")


def redact_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's findings settled with the others: its two spans of one name are one."""
    docs = derived.accented_notes(spark, sf_dir)
    with scan(docs, "doc_id", "text", model=STAND_IN) as result:
        return materialise(result.redacted.select("doc_id", "redacted"), "redacted")


def _array_query(source: Query, recognizers: RecognizerSet, step) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = detect(source(spark, sf_dir), recognizers=recognizers)
        stepped = raw.withColumn("settled", step(F.col("text"), F.col("raw")))
        return explode_findings(stepped, "doc_id", column="settled").drop("pattern_name", "priority")

    return query


MAIL_TWICE = (
    DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS"])
    .with_recognizer("EMAIL_ADDRESS", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0.5, "loose_email")
)
PHRASES = RecognizerSet(()).with_recognizer("PHRASE", PAIR, 0.6, "pair").with_recognizer("PHRASE", TRIPLE, 0.7, "triple")
MEETING = RecognizerSet(()).with_recognizer("PAIR", PAIR, 0.6, "pair").with_recognizer("STOP_WORD", STOP_WORD, 0.7, "stop_word")

dedupe_findings = _array_query(documents, MAIL_TWICE, lambda text, raw: dedupe(raw, ["EMAIL_ADDRESS"]))
merge_phrases = _array_query(
    documents, PHRASES, lambda text, raw: merge_same_entity(text, dedupe(raw, ["PHRASE"]), ["PHRASE"])
)
clip_phrases = _array_query(documents, MEETING, lambda text, raw: clip_overlaps(drop_contained(raw)))
contained_notes = _array_query(notes, DEFAULT_RECOGNIZERS, lambda text, raw: drop_contained(raw))
resolve_notes = _array_query(notes, DEFAULT_RECOGNIZERS, lambda text, raw: clip_overlaps(drop_contained(raw)))


def redact_single(entity: str, source: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        (recognizer,) = DEFAULT_RECOGNIZERS.only([entity])
        changed = redact_one(F.col("text"), recognizer, DEFAULT_RECOGNIZERS, DEFAULT_POLICY[entity])
        return source(spark, sf_dir).select("doc_id", changed.alias("redacted"))

    return query


def redact_with(source: Query, entities=None, policy=DEFAULT_POLICY) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = DEFAULT_RECOGNIZERS if entities is None else DEFAULT_RECOGNIZERS.only(entities)
        done = redact(detect(source(spark, sf_dir), recognizers=chosen), overlapping_entities(chosen), policy)
        return done.select("doc_id", "redacted")

    return query


FROM_END = {
    **DEFAULT_POLICY,
    "EMAIL_ADDRESS": mask_with("*", 10, from_end=True),
    "CREDIT_CARD": mask_with("#", 4, from_end=True),
}


def redact_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns and the whole table of customer names together."""
    found = scan(letters(spark, sf_dir), "doc_id", "text", names=customer_names(spark, sf_dir))
    return found.redacted.select("doc_id", "redacted")


def label_verdicts(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Verdict rows from the labels of the documents a value occurs in."""
    labels = table(spark, sf_dir, "labels")
    response = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(" True\n"))
        .when(F.col("quality") == 1, F.lit("true."))
        .when(F.col("toxic") == 0, F.lit("TRUE"))
        .otherwise(F.lit("False"))
    )
    return found.join(labels, "doc_id").select("entity", "value", response.alias("response"))


SCORED = DEFAULT_RECOGNIZERS.with_recognizer("HEX_TOKEN", HEX_TOKEN, 0.5, "hex_token")


def kept_findings(spark: SparkSession, sf_dir: str, recognizers: RecognizerSet = DEFAULT_RECOGNIZERS) -> DataFrame:
    """Findings on disk: verdicts are derived from them and joined to them."""
    return materialise(explode_findings(detect(documents(spark, sf_dir), recognizers=recognizers), "doc_id"), "findings")


def verify_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept_findings(spark, sf_dir)
    joined = verify.join_verdicts(found, label_verdicts(spark, sf_dir, found))
    verdict = F.coalesce(F.col("verdict").cast("string"), F.lit("missing"))
    return joined.select("doc_id", "entity", "start", "value", verdict.alias("verdict"))


def verify_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_verdicts(spark, sf_dir, kept_findings(spark, sf_dir))
    return rows.select("entity", "value", "response", verify.is_true(F.col("response")).alias("verdict"))


def has_seven(batch):
    """A stand-in classifier: values with a 7 are sensitive."""
    return batch["value"].str.contains("7").map({True: "True", False: "False"})


def verify_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.classify(verify.distinct_values(all_findings(spark, sf_dir)), has_seven)


def verify_confirmed(on_missing: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = kept_findings(spark, sf_dir, SCORED)
        kept = verify.confirm(found, label_verdicts(spark, sf_dir, found), on_missing=on_missing)
        return kept.select("doc_id", "entity", "start", "value", "score")

    return query


def seven_or_fail(batch):
    """A stand-in for a service that fails on values with a 3."""
    if batch["value"].str.contains("3").any():
        raise RuntimeError("no answer")
    return has_seven(batch)


def verify_failed_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value whose classifier fails has no verdict; with 'keep' it is redacted all the same."""
    result = scan(documents(spark, sf_dir), "doc_id", "text", classifier=seven_or_fail, on_missing="keep")
    return result.redacted.select("doc_id", "redacted")


def verify_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents against the labelled examples and the labels' verdicts together."""
    found = kept_findings(spark, sf_dir)
    verdicts = verify.seed_verdicts(spark).unionByName(label_verdicts(spark, sf_dir, found))
    return verify.confirm(found, verdicts).select("doc_id", "entity", "start", "value", "score")


def verify_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.distinct_values(all_findings(spark, sf_dir))


def verify_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only confirmed findings are replaced."""
    docs = documents(spark, sf_dir)
    verdicts = label_verdicts(spark, sf_dir, kept_findings(spark, sf_dir))
    return scan(docs, "doc_id", "text", verdicts=verdicts).redacted.select("doc_id", "redacted")


def verify_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds: the documents, then all sources. The second asks only for values that the first did not have."""
    store = VerdictStore(spark, work_folder(spark, "store"), 8)
    first = store.ask(all_findings(spark, sf_dir), has_seven)
    second = store.ask(explode_findings(detect(all_sources(spark, sf_dir)), "doc_key"), has_seven)
    return first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))


def verify_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings confirmed by what the store has kept of an earlier round."""
    store = VerdictStore(spark, work_folder(spark, "store"), 8)
    found = kept_findings(spark, sf_dir)
    store.ask(found, has_seven)
    return store.confirm(found).select("doc_id", "entity", "start", "value", "score")


def report_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_entries(all_findings(spark, sf_dir), "doc_id")


def report_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept_findings(spark, sf_dir)
    kept = verify.confirm(found, label_verdicts(spark, sf_dir, found))
    return report.report_entries(kept, "doc_id", confirmed=True)


def report_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_joined(detect(documents(spark, sf_dir)), "doc_id")


def report_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.hide_values(all_findings(spark, sf_dir)).select("doc_id", "entity", "start", "end", "value_hash")


def count_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.count_by_entity(all_findings(spark, sf_dir))


def count_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.count_by_document(detect(documents(spark, sf_dir)), "doc_id")


PIVOTED = [e for e in ENTITIES if e != "PERSON"]


def pivot_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pivot_by_document(detect(notes(spark, sf_dir)), PIVOTED, "doc_id")


def rollup_source_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explode_findings(detect(all_sources(spark, sf_dir)), "source", "doc_key")
    totals = report.rollup_counts(found, "source", "entity")
    all_of = F.lit("(all)")
    return totals.select(
        F.coalesce("source", all_of).alias("source"), F.coalesce("entity", all_of).alias("entity"), "n"
    )


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_sources(spark, sf_dir)


def scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_sources(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"))


def filter_url_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.where(is_repository(F.col("url")))


def repository_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatch on both kinds of source: page URLs and document paths."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("input"))
    paths = table(spark, sf_dir, "documents").select(F.expr(derived.FILE_PATH).alias("input"))
    return pages.unionByName(paths).select("input", is_repository(F.col("input")).alias("is_repository"))


def path_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with inputs by their name: page addresses, paths of documents, and blanks among them."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("input"))
    blank = F.when(F.col("source") == "src10", F.lit(" \t")).when(F.col("source") != "src11", F.expr(derived.FILE_PATH))
    paths = table(spark, sf_dir, "documents").select(blank.alias("input"))
    return pages.unionByName(paths).select("input", path_problem(F.col("input")).alias("problem"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_blocks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def sparse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_blocks(derived.sparse_pages(spark, sf_dir), "conv_id", "page", "role", "text")


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_pages(blocks(spark, sf_dir), "conv_id")


def assembled_in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_segments(blocks(spark, sf_dir), "conv_id", 3)


def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select("doc_id", F.expr(derived.FILE_PATH).alias("path"))
    return paths.select("doc_id", "path", file_kind(F.col("path")).alias("kind"))


def text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select("doc_id", F.expr(derived.FILE_PATH).alias("path"))
    return paths.where(is_text_path(F.col("path")))


def kind_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(table(spark, sf_dir, "documents").select(F.expr(derived.FILE_PATH).alias("path")))


def decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.document_files(spark, sf_dir)
    return files.select("doc_id", decode(F.col("content")).alias("text"))


def file_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.document_files(spark, sf_dir)
    return files.select(
        "doc_id", source_encoding(F.col("content")).alias("encoding"), had_crlf(F.col("content")).alias("had_crlf")
    )


def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written out as a tree of text files, scanned back as files."""
    root = work_folder(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))
    tree.write_lines(docs, root, "doc_id")
    return tree.read_texts(spark, root).select(derived.doc_id_of().alias("doc_id"), "text")


def _email_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    (recognizer,) = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS"])
    changed = redact_one(F.col("text"), recognizer, DEFAULT_RECOGNIZERS, DEFAULT_POLICY["EMAIL_ADDRESS"])
    return documents(spark, sf_dir).withColumn("redacted", changed)


def scrub_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.scrub_status(_email_redacted(spark, sf_dir), "doc_id", backup_stamp="20250101_000000")


def scrub_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _email_redacted(spark, sf_dir)
    return done.select("doc_id", versions.output_text(F.col("text"), F.col("redacted"), append=True).alias("text"))


def scrub_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.scrub_summary(scrub_status(spark, sf_dir))


def _without_sevens(on_null: str):
    """A user's operation that has no answer for values with a 7."""
    hidden = lambda value: F.when(~F.contains(value, F.lit("7")), F.concat(F.lit("<"), F.length(value), F.lit(">")))
    return {"EMAIL_ADDRESS": custom(hidden, on_null)}


def redact_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's operation; where it gives null, the value is masked whole and the text around it stays."""
    return redact_with(documents, ["EMAIL_ADDRESS"], _without_sevens("mask"))(spark, sf_dir)


def pseudonyms(values):
    """A user's operation in Python: the same value has the same pseudonym everywhere; none for values with a 7."""
    import hashlib

    return [None if "7" in value else f"user-{hashlib.sha256(value.encode()).hexdigest()[:8]}" for value in values]


def redact_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = {**DEFAULT_POLICY, "EMAIL_ADDRESS": custom_batch(pseudonyms)}
    return redact_with(documents, ["EMAIL_ADDRESS", "CREDIT_CARD"], policy)(spark, sf_dir)


def scrub_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for which the user's operation fails are errors, the others go on."""
    mails = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS"])
    done = redact(detect(documents(spark, sf_dir), recognizers=mails), policy=_without_sevens("error"))
    return versions.scrub_status(done, "doc_id")


def redacted_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.redacted_in_order(_email_redacted(spark, sf_dir), "doc_id")


def find_in_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts only, by the recognizers meant for them."""
    docs = only_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    found = detect(dealt(docs, "doc_id"), recognizers=DEFAULT_RECOGNIZERS.for_language("en").only(["EMAIL_ADDRESS", "CREDIT_CARD"]))
    return explode_findings(found, "doc_id")


def check_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, one directory each: scanned, scrubbed and read back from the published version."""
    root, out = work_folder(spark, "tree"), work_folder(spark, "scrubbed")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))
    tree.write_lines(docs, root, "doc_id")
    with check(spark, root, out, entities=["EMAIL_ADDRESS", "CREDIT_CARD"]):
        pass
    done = versions.read_current(spark, out)
    return done.select(F.regexp_extract("path", r"doc_id=(-?\d+)/", 1).cast("long").alias("doc_id"), "text", "status")


def scan_hidden_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below hidden and underscored directories, listed and read in tasks."""
    root = work_folder(spark, "tree")
    derived.write_tree(spark, sf_dir, root)
    files = tree.text_files(tree.walk(spark, root))
    folder = F.regexp_extract("path", r"/([^/]+)/doc_id=", 1).alias("folder")
    return tree.read_documents(files).select(derived.doc_id_of().alias("doc_id"), folder, "text", "encoding")


def scan_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files read by ranges of 2,000 bytes, and matched unit by unit: the findings of whole documents."""
    root = work_folder(spark, "tree")
    derived.write_tree(spark, sf_dir, root)
    units, _ = units_of_files(tree.text_files(tree.walk(spark, root)), size=2000)
    found = segments.findings_of_units(segments.detect_units(units), "path")
    return found.select(derived.doc_id_of().alias("doc_id"), "entity", "start", "end", "value", "score")


def scrub_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files, and more files beside them that are gone between listing and reading.

    The lost files are error rows; every document is scrubbed, in units where it is large.
    """
    root = work_folder(spark, "tree")
    derived.write_tree(spark, sf_dir, root)
    derived.write_lost(spark, sf_dir, root)
    files = materialise(tree.text_files(tree.walk(spark, root)), "files")
    remove_folders(spark, [f"{root}/{derived.LOST_FOLDER}"])
    mails = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS"])
    done = redact(detect(file_documents(files, mails, True, []), recognizers=mails))
    status = versions.status_of_documents(versions.scrub_status(done, "path", reason="unread"), "path")
    # Without the path, which is another in every run.
    return status.select(derived.doc_id_of().alias("doc_id"), "status", F.regexp_replace("error", r"(?<=modifying ).*(?=: )", "").alias("error"))


def findings_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings, each text matched in pieces of 200 characters."""
    return segments.segmented_findings(documents(spark, sf_dir), "doc_id", size=200)


def findings_segmented_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segmented_findings(notes(spark, sf_dir), "doc_id", size=20)


def findings_segmented_text_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passwords whose classes may stand anywhere ahead in the text, that is in any later piece."""
    wide = DEFAULT_RECOGNIZERS.only(["PASSWORD"]).with_scope("text")
    return segments.segmented_findings(documents(spark, sf_dir), "doc_id", recognizers=wide, size=200)


def redact_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segmented_texts(documents(spark, sf_dir), "doc_id", size=200)


def empty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to their first line of more than 60 characters: some are empty, and empty files are not documents."""
    files = derived.document_files(spark, sf_dir)
    line = F.regexp_extract(decode(F.col("content")), r"(?m)^[^\n]{60,}$", 0)
    listed = files.select("doc_id", "path", F.encode(line, "UTF-8").alias("content")).withColumn("length", F.length("content").cast("long"))
    return listed.where(is_text_path(F.col("path")) & (F.col("length") > 0)).select("doc_id", "length")


def unmatched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.unmatched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory in which no file has a text extension: the pictures among the documents' paths."""
    paths = table(spark, sf_dir, "documents").select(F.expr(derived.FILE_PATH).alias("path"), "text")
    pictures = paths.where(file_kind(F.col("path")) == "image")
    none = pictures.where(is_text_path(F.col("path"))).withColumn("redacted", F.col("text"))
    return versions.status_or_empty(none, versions.scrub_status(none, "path"))


def backup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.backup_rows(_email_redacted(spark, sf_dir), "doc_id")


def derived_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of backups: all documents, the labelled ones, the English ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()

    def at(rows: DataFrame, ts: str) -> DataFrame:
        return rows.select("doc_id", F.concat(F.lit(f"{ts} "), "text").alias("text"), F.lit(ts).alias("ts"))

    return (
        at(d, "20250101_000000")
        .unionByName(at(d.join(labels, "doc_id", "left_semi"), "20250102_000000"))
        .unionByName(at(d.where("lang = 'en'"), "20250101_120000"))
    )


def latest_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest_backup(derived_backups(spark, sf_dir), "doc_id").select("doc_id", "ts", "text")


def restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents back to the backups taken when their emails were masked."""
    done = _email_redacted(spark, sf_dir)
    originals = versions.backup_rows(done, "doc_id").withColumn("ts", F.lit("20250101_000000"))
    return versions.restore(done.select("doc_id", F.col("redacted").alias("text")), originals, "doc_id")


def write_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals as one version, the masked texts as the next; reads the current one."""
    root = work_folder(spark, "versions")
    done = _email_redacted(spark, sf_dir)
    versions.write_version(done.select("doc_id", "text"), root)
    versions.write_scrubbed(done, root, "doc_id")
    return versions.read_current(spark, root).select("doc_id", "text", "status")


def restore_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrub into a version with backups, roll back, and read the version that is published then."""
    root = work_folder(spark, "restored")
    versions.write_scrubbed(_email_redacted(spark, sf_dir), root, "doc_id")
    versions.rollback(spark, root, "doc_id")
    return versions.read_current(spark, root).select("doc_id", "text")


def read_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions: all documents, e-mails masked, then cards masked in that; the last two hold only what changed."""
    root = work_folder(spark, "manifest")
    entry = manifest.write_full(documents(spark, sf_dir), root, manifest.Entry(), "doc_id")
    for entity in ("EMAIL_ADDRESS", "CREDIT_CARD"):
        (recognizer,) = DEFAULT_RECOGNIZERS.only([entity])
        state = manifest.read_merged(spark, root, "doc_id", entry)
        done = state.withColumn("redacted", redact_one(F.col("text"), recognizer, DEFAULT_RECOGNIZERS, DEFAULT_POLICY[entity]))
        entry = manifest.write_changes(done, root, entry, "doc_id")
    return manifest.read_merged(spark, root, "doc_id")


def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a version of changes holds of each document: its status, and the lengths of the texts that it keeps."""
    root = work_folder(spark, "manifest")
    entry = manifest.write_full(documents(spark, sf_dir), root, manifest.Entry(), "doc_id")
    entry = manifest.write_changes(_email_redacted(spark, sf_dir), root, entry, "doc_id")
    rows = spark.read.parquet(f"{root}/data/version={entry.chain[-1]}")
    length = lambda kind: F.max(F.when(F.col("kind") == kind, F.length("text"))).alias(f"{kind}_chars")
    return rows.groupBy("doc_id").agg(F.max("status").alias("status"), length("new"), length("original"))


def stream_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that arrive in several batches, with a table of names, then all again: no batch is written twice."""
    arriving, root, checkpoint = (work_folder(spark, name) for name in ("arriving", "streamed", "progress"))
    letters(spark, sf_dir).repartition(3).write.parquet(arriving)
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(arriving)
    names = customer_names(spark, sf_dir)
    for _ in range(2):
        start_scrub(stream, root, checkpoint, key="doc_id", names=names).awaitTermination()
    entry = manifest.current(spark, root)
    statuses = [manifest.read_status(spark, root, version, "doc_id").select("doc_id", "status") for version in entry.chain]
    return manifest.read_merged(spark, root, "doc_id").join(reduce(DataFrame.unionAll, statuses), "doc_id")


QUERIES: dict[str, Query] = {
    "find_email": find("EMAIL_ADDRESS", documents),
    "find_phone": find("PHONE_NUMBER", documents),
    "find_credit_card": find("CREDIT_CARD", documents),
    "find_api_key": find("API_KEY", documents),
    "find_api_key_any_case": find("API_KEY", documents, DEFAULT_RECOGNIZERS.with_flags("i")),
    "find_password": find("PASSWORD", documents),
    "find_password_text_scope": find("PASSWORD", documents, DEFAULT_RECOGNIZERS.with_scope("text")),
    "find_password_token_scope": find("PASSWORD", notes, DEFAULT_RECOGNIZERS.with_scope("token")),
    "find_ssn": find("US_SSN", notes),
    "find_aadhaar": find("AADHAAR_NUMBER", notes),
    "find_pan": find("PAN_NUMBER", notes),
    "find_address": find("ADDRESS", notes),
    "find_ssh_key": find("SSH_KEY", notes),
    "find_person": find_person,
    "findings_all": all_findings,
    "findings_notes": lambda spark, sf_dir: explode_findings(detect(notes(spark, sf_dir)), "doc_id"),
    "score_recognizers": score_recognizers,
    "score_confirmed": score_confirmed,
    "findings_model": findings_model,
    "redact_with_model": redact_with_model,
    "findings_allow_list": findings_allow_list,
    "findings_custom_recognizer": findings_custom,
    "findings_many": findings_many,
    "findings_provenance": findings_provenance,
    "dedupe_findings": dedupe_findings,
    "merge_same_entity": merge_phrases,
    "drop_contained": contained_notes,
    "clip_overlaps": clip_phrases,
    "resolve_notes": resolve_notes,
    "redact_email": redact_single("EMAIL_ADDRESS", documents),
    "redact_credit_card": redact_single("CREDIT_CARD", documents),
    "redact_phone_ssn": redact_with(notes, ["PHONE_NUMBER", "US_SSN"]),
    "redact_aadhaar_pan": redact_with(notes, ["AADHAAR_NUMBER", "PAN_NUMBER"]),
    "redact_replace": redact_with(notes, ["ADDRESS", "SSH_KEY", "API_KEY"]),
    "redact_all": redact_with(documents),
    "redact_notes": redact_with(notes),
    "redact_from_end": redact_with(documents, ["EMAIL_ADDRESS", "CREDIT_CARD"], FROM_END),
    "redact_with_names": redact_with_names,
    "redact_custom": redact_custom,
    "redact_udf": redact_udf,
    "redacted_in_order": redacted_in_order,
    "find_in_language": find_in_language,
    "verify_join": verify_join,
    "verify_parse": verify_parse,
    "verify_fail_closed": verify_confirmed("drop"),
    "verify_score_gate": verify_confirmed("keep"),
    "verify_failed_keep": verify_failed_keep,
    "verify_seeded": verify_seeded,
    "verify_distinct": verify_distinct,
    "verify_incremental": verify_incremental,
    "verify_from_store": verify_from_store,
    "verify_classified": verify_classified,
    "verify_redacted": verify_redacted,
    "report_entries": report_entries,
    "report_confirmed": report_confirmed,
    "report_joined": report_joined,
    "report_hashed": report_hashed,
    "count_by_entity": count_by_entity,
    "count_by_doc": count_by_doc,
    "pivot_by_doc": pivot_by_doc,
    "rollup_source_entity": rollup_source_entity,
    "union_sources": union_sources,
    "scan_count": scan_count,
    "filter_url_sources": filter_url_sources,
    "repository_flags": repository_flags,
    "path_problems": path_problems,
    "page_blocks": blocks,
    "page_blocks_sparse": sparse_blocks,
    "assemble_pages": assembled,
    "assemble_pages_in_segments": assembled_in_segments,
    "classify_paths": classify_paths,
    "text_paths": text_paths,
    "kind_coverage": kind_coverage,
    "scan_tree": scan_tree,
    "check_tree": check_tree,
    "scan_hidden_tree": scan_hidden_tree,
    "scan_in_ranges": scan_in_ranges,
    "scrub_unreadable": scrub_unreadable,
    "findings_segmented": findings_segmented,
    "findings_segmented_notes": findings_segmented_notes,
    "findings_segmented_text_scope": findings_segmented_text_scope,
    "redact_segmented": redact_segmented,
    "empty_files": empty_files,
    "decode_fallback": decode_fallback,
    "file_encodings": file_encodings,
    "scrub_status": scrub_status,
    "scrub_append": scrub_append,
    "scrub_summary": scrub_summary,
    "scrub_errors": scrub_errors,
    "unmatched_results": unmatched_results,
    "empty_input": empty_input,
    "backup_rows": backup_rows,
    "latest_backup": latest_backup,
    "restore": restore,
    "restore_written": restore_written,
    "write_versions": write_versions,
    "read_merged": read_merged,
    "changed_only": changed_only,
    "stream_scrub": stream_scrub,
}
