"""The whole run: documents in, findings, redacted texts and status out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.words import listed_names
from veilspan.operators.detect import NO_FINDINGS, detect, explode_findings, gather_findings
from veilspan.operators.model import FAILED, ModelHook, with_model
from veilspan.operators.names import matched, with_candidates
from veilspan.operators.redact import redact
from veilspan.operators.report import report_entries
from veilspan.operators.resolve import overlapping_entities
from veilspan.operators.segments import is_known, scope_of
from veilspan.operators.verify import MIN_SCORE, classify, confirm, distinct_values
from veilspan.policy import DEFAULT_POLICY, Rule, require_rules
from veilspan.recognizers import DEFAULT_RECOGNIZERS, RecognizerSet
from veilspan.session import materialise, remove_folders
from veilspan.sources import tree, versions
from veilspan.sources.files import MAX_BYTES, check_directory, documents_of, list_files, oversized, text_files
from veilspan.sources.ranges import units_of_files


ROW = "_row"
#: What a file's row tells beside its text: how it was written, and why it could not be read.
FORM, REASON = ("encoding", "had_crlf"), "unread"


@dataclass
class ScanResult:
    """``findings`` before overlap resolution; ``redacted`` one row per document (one per unit of a very large file).

    ``close`` removes what was staged in the shared work folder (raw texts among it); the frames cannot be read after it.
    Used as a context manager, the result closes itself.
    """

    findings: DataFrame
    redacted: DataFrame
    entries: DataFrame
    key: str = "path"
    scrub_status: DataFrame | None = None
    scrub_summary: DataFrame | None = None
    folders: list[str] = field(default_factory=list)

    def close(self) -> None:
        remove_folders(self.redacted.sparkSession, self.folders)
        self.folders.clear()

    def __enter__(self) -> ScanResult:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def stage(detected: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """Texts and detection results written once, with a number for each row, split by whether anything was found."""
    found = F.size("raw") > 0
    if "people" in detected.columns:
        found = found | (F.size("people") > 0)
    hit = F.when(found, F.lit("yes")).otherwise(F.lit("no"))
    numbered = detected.withColumn("hit", hit).withColumn(ROW, F.monotonically_increasing_id())
    return materialise(numbered, "detected", "hit", folders=folders)


def scan(
    documents: DataFrame,
    key: str = "path",
    text: str = "text",
    recognizers: RecognizerSet = DEFAULT_RECOGNIZERS,
    entities: Iterable[str] | None = None,
    names: Sequence[str] | DataFrame | None = None,
    verdicts: DataFrame | None = None,
    classifier=None,
    on_missing: str = "drop",
    min_score: float = MIN_SCORE,
    policy: Mapping[str, Rule] = DEFAULT_POLICY,
    staged: bool = False,
    keep: Sequence[str] = (),
    offset: str | None = None,
    model: ModelHook | None = None,
) -> ScanResult:
    """Find and redact sensitive values in ``documents[text]``; columns in ``keep`` stay beside the redacted texts.

    ``offset`` is one of them: where a row's text begins in its document. Places of findings are then the document's.
    ``model`` finds spans beside the patterns; it is asked once, and a text for which it fails has no redacted text.

    Without verdicts and with at most a list of names everything happens inside the row: one scan, no shuffle. Verdicts, a
    classifier and a name table need joins; these move findings, and only texts that have findings (or words that may begin a
    name) meet them again. Because findings are then used several times, texts and findings are written once to the
    shared work folder, and so are a classifier's answers: each value is asked once for all results.
    ``staged`` forces that for scans that would not need it. Rows are told apart by a number of their own, so a key that
    repeats mixes nothing up.
    """
    if entities is not None:
        wanted = list(entities)
        recognizers = recognizers.only(wanted)
        if "PERSON" not in wanted:
            names = None
    listed = None
    if isinstance(names, DataFrame):
        listed, names = listed_names(names), None
    has_names = bool(names) or listed is not None
    require_rules(policy, [r.entity for r in recognizers] + (["PERSON"] if has_names else []))
    found_by_model = set(model.entities.values()) if model is not None else set()
    require_rules(policy, sorted(found_by_model))
    shared = sorted({*overlapping_entities(recognizers, has_names), *found_by_model})

    folders: list[str] = []
    docs = documents.select(F.col(key), F.col(text).alias("text"), *keep)
    keep = [*keep, *([FAILED] if model is not None else [])]
    shown = [key, "text", "raw", "kept", "redacted", *keep]
    detected = detect(docs, "text", recognizers, names or ())
    if model is not None:
        detected, staged = with_model(detected, model, recognizers), True
    if listed is not None:
        listed = materialise(listed, "names", folders=folders)
        detected = with_candidates(detected, "text", listed)
    verifying = verdicts is not None or classifier is not None
    joining = verifying or listed is not None
    place = [] if offset is None else [offset]

    def moved(findings: DataFrame) -> DataFrame:
        return findings if offset is None else findings.withColumns({n: F.col(n) + F.col(offset) for n in ("start", "end")}).drop(offset)

    if not (joining or staged):
        findings = moved(explode_findings(detected, key, *place))
        redacted = redact(detected, shared, policy).select(*shown)
        return ScanResult(findings, redacted, report_entries(findings, key), key)

    detected = stage(detected, folders)
    hits = detected.where("hit = 'yes'")
    findings = explode_findings(hits, key, ROW, *place)
    if listed is not None:
        findings = findings.unionByName(matched(hits, listed, key, ROW, *place))
    if classifier is not None:
        answers = materialise(classify(distinct_values(findings), classifier), "answers", folders=folders)
        verdicts = answers if verdicts is None else verdicts.unionByName(answers)
    if verifying:
        findings = confirm(findings, verdicts, on_missing=on_missing, min_score=min_score)
    if joining:
        # Documents in which nothing was found bypass the join, so their texts are not shuffled.
        arrays = gather_findings(findings, ROW, column="raw")
        settled = F.coalesce("raw", F.expr(NO_FINDINGS)).alias("raw")
        clean = detected.where("hit = 'no'").select(key, "text", F.expr(NO_FINDINGS).alias("raw"), *keep)
        met = hits.select(key, ROW, "text", *keep).join(arrays, ROW, "left").select(key, "text", settled, *keep)
        detected = clean.unionByName(met)
    redacted = redact(detected, shared, policy).select(*shown)
    if model is not None:
        redacted = redacted.withColumn("redacted", F.when(~F.col(FAILED), F.col("redacted")))
    findings = moved(findings.drop(ROW))
    return ScanResult(findings, redacted, report_entries(findings, key, confirmed=verifying), key, folders=folders)


def check(
    spark: SparkSession,
    indir: str | Sequence[str],
    out: str | None = None,
    verdicts: DataFrame | None = None,
    classifier=None,
    scrub_files: bool = True,
    create_backup: bool = True,
    append_to_files: bool = False,
    **options,
) -> ScanResult:
    """Scan directories; with ``scrub_files`` write the redacted texts under ``out``.

    The source files stay as they are: ``out`` gets a new version of every document
    and, with ``create_backup``, the originals of the changed ones. A file that cannot be read is an error among the
    statuses, with the reason. Where tasks can list the directories themselves (``tree.listable``), hidden directories
    are walked too, files of any size are matched in units, and the version tells each file's encoding and line ends; else
    Spark's own lister is used.
    """
    if scrub_files and out is None:
        raise ValueError("scrub_files needs an output folder")
    roots = [indir] if isinstance(indir, str) else list(indir)
    for root in roots:
        check_directory(spark, root)
    if not all(tree.listable(root) for root in roots):
        files = text_files(list_files(spark, roots))
        result = scan(documents_of(files), "path", "text", verdicts=verdicts, classifier=classifier, **options)
        return scrub(result, out, create_backup, append_to_files, oversized(files)) if scrub_files else result
    folders: list[str] = []
    files = materialise(tree.text_files(tree.walk(spark, roots, folders)), "files", folders=folders)
    docs = file_documents(files, options.get("recognizers", DEFAULT_RECOGNIZERS), not (options.get("names") or append_to_files), folders)
    result = scan(
        docs.withColumn("text", F.concat("text", "ahead")), "path", "text", verdicts=verdicts, classifier=classifier,
        keep=("unit", "unit_start", "ahead", *FORM, REASON), offset="unit_start", **options,
    )
    own = {c: F.substring(F.col(c), F.lit(1), F.length(c) - F.length("ahead")) for c in ("text", "redacted")}
    result.redacted = result.redacted.withColumns({c: F.when(F.col("ahead") == "", F.col(c)).otherwise(x) for c, x in own.items()}).drop("ahead", "unit_start")
    result.folders.extend(folders)
    return scrub(result, out, create_backup, append_to_files) if scrub_files else result


def file_documents(files: DataFrame, recognizers: RecognizerSet, cuttable: bool, folders: list[str]) -> DataFrame:
    """Rows of listed files to be matched: whole files, and the units of those above ``tree.WHOLE`` bytes.

    path, unit, unit_start, ahead, text, encoding, had_crlf and the reason of a file without text. Where texts cannot be
    cut (names, patterns of the user's own), files up to what a row holds are read whole and larger ones are errors.
    """
    cuttable = cuttable and is_known(recognizers)
    whole = tree.WHOLE if cuttable else MAX_BYTES
    one = [F.lit(0).cast("long").alias("unit"), F.lit(0).cast("long").alias("unit_start"), F.lit("").alias("ahead")]
    docs = tree.read_documents(files, whole).select("*", *one)
    large = files.where((F.col("length") > whole) & F.col("error").isNull())
    if large.isEmpty():
        return docs
    if cuttable:
        units, unreadable = units_of_files(large, scope_of(recognizers), folders=folders)
        docs = docs.unionByName(units)
    else:
        unreadable = large.select("path", F.lit(f"larger than {whole} bytes").alias(REASON))
    none = {c: F.lit(None).cast(t) for c, t in (("text", "string"), ("encoding", "string"), ("had_crlf", "boolean"))}
    return docs.unionByName(unreadable.select("path", REASON, *one).withColumns(none))


def scrub(
    result: ScanResult, out: str, create_backup: bool = True, append: bool = False, unread: DataFrame | None = None
) -> ScanResult:
    """Write the redacted texts as a new version; statuses are read back from it.

    ``unread`` are status rows of inputs that could not be read; they stand beside the others.
    """
    spark = result.redacted.sparkSession
    # Only the key column is read for this test, so nothing is matched yet.
    if result.redacted.select(result.key).isEmpty() and (unread is None or unread.isEmpty()):
        status = versions.status_of_empty(spark)
        return replace(result, scrub_status=status, scrub_summary=versions.scrub_summary(status))
    carried = set(result.redacted.columns)
    version = versions.write_scrubbed(
        result.redacted, out, result.key, create_backup=create_backup, append=append,
        form=[c for c in ("unit", *FORM) if c in carried], reason=REASON if REASON in carried else None,
    )
    status = versions.read_status(spark, out, version, result.key)
    if "unit" in carried:
        status = versions.status_of_documents(status, result.key)
    if unread is not None:
        status = status.unionByName(unread)
    return replace(result, scrub_status=status, scrub_summary=versions.scrub_summary(status))
