"""Tables derived from the given ones, stated once as SQL both engines run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.session import dealt, dealt_rows
from veilspan.sources import tree

_ID = "cast(c_custkey as string)"


def _padded(number: str, digits: int) -> str:
    return f"lpad(cast({number} as string),{digits},'0')"


# A text per customer that holds all ten pattern entities: its parts, with the entity that a part is.
NOTE_PARTS = (
    (None, "'Contact '"),
    ("PERSON", "c_name"),
    (None, "' at '"),
    ("EMAIL_ADDRESS", f"concat('u', {_ID}, '@mail.example.com')"),
    (None, "' or '"),
    ("PHONE_NUMBER", f"concat('+1 (555) 010-', {_padded('c_custkey % 10000', 4)})"),
    (None, "'. SSN '"),
    ("US_SSN", f"concat({_padded('c_custkey % 900', 3)}, '-', {_padded('c_custkey % 97', 2)}, '-', {_padded('c_custkey % 9973', 4)})"),
    (None, "'. Lives at '"),
    ("ADDRESS", f"concat(cast(c_custkey % 900 + 1 as string), ' Main St, Anytown, CA ', {_padded('c_custkey % 99991', 5)})"),
    (None, "'. Password '"),
    ("PASSWORD", f"concat('Pw', {_padded('c_custkey', 6)}, '@x')"),
    (None, "'. Aadhaar '"),
    ("AADHAAR_NUMBER", f"concat({_padded('c_custkey % 9999', 4)}, ' 5678 9012')"),
    (None, "'. PAN '"),
    ("PAN_NUMBER", f"concat(translate({_padded('c_custkey % 100000', 5)},'0123456789','ABCDEFGHIJ'), {_padded('c_custkey % 10000', 4)}, 'Z')"),
    (None, "'. Card '"),
    ("CREDIT_CARD", f"concat('4', {_padded('c_custkey', 15)})"),
    (None, "'. Key '"),
    ("API_KEY", "concat('sk-', md5(c_name))"),
    (None, "concat('.', chr(10))"),
    ("SSH_KEY", f"concat('ssh-rsa ', md5({_ID}), ' u@h')"),
    (None, "concat(chr(10), 'end')"),
)
NOTE_TEXT = f"concat({', '.join(part for _, part in NOTE_PARTS)})"

# The same with letters of two bytes in front.
ACCENTED = f"concat('Señor né ', {NOTE_TEXT})"

# A file name per document; the source decides the kind of file.
FILE_SUFFIX = """case source
 when 'src0' then '.txt' when 'src1' then '.LOG' when 'src2' then '.csv' when 'src3' then '.Json'
 when 'src4' then '.xml' when 'src5' then '.html' when 'src6' then '.py' when 'src7' then '.md'
 when 'src8' then '.yml' when 'src9' then '.ini' when 'src10' then '' when 'src11' then '.png'
 when 'src12' then '.JPEG' when 'src13' then '.pdf' when 'src14' then '.yaml' when 'src15' then '.tar.json'
 when 'src16' then '.txt.backup_20250101_000000' when 'src17' then '.exe' when 'src18' then '.tiff' else '.txt' end"""
# Names of one to five words, some with an initial, and letters that mention two of them.
FULL_NAME = """case {key} % 5 when 0 then {name} when 1 then concat('J. ', {name}) when 2 then concat('Ann ', {name}, ' Lee')
 when 3 then concat('Maria del  Carmen ', {name}) else concat('Maria del Carmen ', {name}, ' Ruiz') end"""
LETTER_NAME = FULL_NAME.format(key="c_custkey", name="c_name")
OTHER_NAME = FULL_NAME.format(key="(c_custkey + 1)", name="concat('Agent', cast(c_custkey as string))")
LETTER_TEXT = f"""concat('Dear ', replace({LETTER_NAME}, 'del  ', 'del'||chr(10)), ', not ', {OTHER_NAME}, ' nor Ann Lee: mail u',
 cast(c_custkey as string), '@mail.example.com. J. Doe')"""

FILE_PREFIX = "case when source = 'src19' then '.hidden' else 'doc' end"
FILE_PATH = f"concat('/data/', lang, '/', source, '/', {FILE_PREFIX}, cast(doc_id as string), {FILE_SUFFIX})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return dealt_rows(rows, "c_custkey").selectExpr("c_custkey as doc_id", f"{NOTE_TEXT} as text")


def note_spans() -> list[tuple[str, str, str]]:
    """Entity, start and end of the true spans of a note, as SQL over a customer."""
    out, before = [], "0"
    for entity, part in NOTE_PARTS:
        end = f"{before} + length({part})"
        if entity not in (None, "PERSON"):
            out.append((entity, before, end))
        before = end
    return out


def true_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, entity, start and end of what the notes were made of."""
    customers = dealt_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    # Lengths first: a place is a sum over all parts before it, which would make them anew for every span.
    lengths = customers.selectExpr("c_custkey as doc_id", *[f"length({part}) as l{k}" for k, (_, part) in enumerate(NOTE_PARTS)])
    place = lambda k: "int(" + " + ".join(["0", *[f"l{j}" for j in range(k)]]) + ")"
    rows = [
        f"struct('{entity}' as entity, {place(k)} as start, {place(k + 1)} as end)"
        for k, (entity, _) in enumerate(NOTE_PARTS) if entity not in (None, "PERSON")
    ]
    return lengths.selectExpr("doc_id", f"inline(array({', '.join(rows)}))")


def accented_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return dealt_rows(rows, "c_custkey").selectExpr("c_custkey as doc_id", f"{ACCENTED} as text")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return dealt_rows(rows, "c_custkey").selectExpr("c_custkey as doc_id", f"{LETTER_TEXT} as text")


def customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return dealt_rows(rows, "c_custkey").selectExpr(f"{LETTER_NAME} as name")


def sparse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose page numbers have gaps and nulls."""
    turns = table(spark, sf_dir, "conversations")
    return turns.selectExpr("nullif(conv_id, 3) as conv_id", "case when turn % 4 = 3 then null else turn * 700 end as page", "role", "text")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file contents: some Latin-1, some with Windows or old Mac line ends, some with a BOM."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    windows = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    content = (
        F.when(F.col("source").isin("src0", "src1", "src2"), F.encode("text", "ISO-8859-1"))
        .when(F.col("source").isin("src3", "src4"), F.encode(windows, "UTF-8"))
        .when(F.col("source") == "src5", F.encode(F.replace("text", F.lit("\n"), F.lit("\r")), "ISO-8859-1"))
        .when(F.col("source") == "src6", F.encode(F.concat(F.lit("\ufeff"), "text"), "UTF-8"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return dealt(d, "doc_id").select("doc_id", F.expr(FILE_PATH).alias("path"), content.alias("content"))


#: Where documents go as files: hidden and underscored directories, and a plain one.
TREE_FOLDERS = (".a", "_b/.c", "c")


#: Where files go that are listed and then lost.
LOST_FOLDER = "lost"


def write_tree(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Every document as a file ``doc_id=N/text.txt`` under one of ``TREE_FOLDERS``; those without an id in the last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))
    number = F.coalesce(F.pmod("doc_id", F.lit(len(TREE_FOLDERS))) + 1, F.lit(len(TREE_FOLDERS)))
    folder = F.element_at(F.array(*[F.lit(f) for f in TREE_FOLDERS]), number.cast("int"))
    tree.write_lines(docs, root, "doc_id", folder)


def write_lost(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Beside the documents' files, one more ``doc_id=N/text.txt`` under ``LOST_FOLDER`` for every third id."""
    ids = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.col("doc_id").cast("string").alias("value"))
    tree.write_lines(ids, root, "doc_id", F.lit(LOST_FOLDER))


def doc_id_of(path: str = "path") -> Column:
    """The id in a path; null for the file of the documents without one."""
    return F.regexp_extract(path, r"doc_id=(-?\d+)/", 1).try_cast("long")
