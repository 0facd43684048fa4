"""Text normalisers, name and id helpers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayline.functions.constants import (
    DASHES, GENBANK, GREEK, MARKS, NOT_UNIPROT, ORGANISM_PARTS, ORGANISMS, PDB, REFSEQ, SUPERSCRIPTS, UNIPROT, WILD_TYPES,
)


def replace_each(c: Column, table: dict[str, str]) -> Column:
    """Literal replacements one after another."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), table.items(), c)


def fix_scientific(c: Column) -> Column:
    """Superscript runs become ^ and plain characters."""
    return F.translate(F.regexp_replace(c, rf"([{SUPERSCRIPTS[0]}]+)", r"^$1"), *SUPERSCRIPTS)


def fix_km(c: Column) -> Column:
    """Molar spelling: µ, no thousands commas, mm and nm as mM and nM, uM in any case as µM, mol/L as M; null for mass
    concentrations. pM stays (SURVEY §9)."""
    t = F.replace(fix_scientific(F.translate(c, "μ", "µ")), F.lit(","), F.lit(""))
    for wrong, right in (("mm", "mM"), ("nm", "nM"), ("(?i:[uµ]M)", "µM"), ("(?i:pM)", "pM")):
        t = F.regexp_replace(t, rf"(?U)\b{wrong}\b", right)
    t = F.regexp_replace(t, r"(?iU)mol/L\b", "M")
    letters = F.regexp_replace(t, r"[^\p{L}]|[xX]", "")
    known = letters.isin("", "M", "mM", "µM", "nM", "pM")
    return F.when(~known & (t.contains("g/") | t.contains("mg")), None).otherwise(t)


#: Time units of a rate; texts of other letters that make it an activity or a concentration.
_TIMES = ["ms", "millisecond", "s", "sec", "second", "m", "min", "minute", "h", "hr", "hour", "day"]
_NO_RATE = r"mol|mg|U|/g|l/|L|(?U)\bM\b|(?iU)\b[mpµn]M\b"


def fix_kcat(c: Column) -> Column:
    """Rate spelling: sec as s, unit-1 as unit^-1; null for activities and concentrations. Texts without letters or
    without digits stay."""
    t = F.replace(fix_scientific(F.translate(c, "μ", "µ")), F.lit(","), F.lit(""))
    letters = F.regexp_replace(t, r"[^\p{L}]|x", "")
    kept = (letters == "") | ~t.rlike(r"\p{Nd}") | letters.isin(*_TIMES)
    u = F.regexp_replace(F.replace(F.translate(t, "−–", "--"), F.lit("-'"), F.lit("-1")), r"(?U)\bsec\b", "s")
    u = F.regexp_replace(u, rf"(?U)\b({'|'.join(_TIMES)})-1\b", "$1^-1")
    return F.when(~kept & t.rlike(_NO_RATE), None).otherwise(u)


def ascii_fold(c: Column, lowercase: bool = True) -> Column:
    c = F.lower(c) if lowercase else c
    return replace_each(replace_each(F.regexp_replace(c, f"[{DASHES}]", "-"), GREEK), MARKS)


def greek_names(c: Column) -> Column:
    return replace_each(c, GREEK)


def fix_organism(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ORGANISMS.items() for x in kv])
    return replace_each(F.coalesce(table[c], c), ORGANISM_PARTS)


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r'[!"():\[\]^]', "")


def is_na(c: Column) -> Column:
    """Null, empty, 'nan', 'None' or '[]' as text; 0."""
    t = c.cast("string")
    return t.isNull() | F.lower(t).isin("", "nan", "none", "[]") | F.coalesce(t.try_cast("double") == 0, F.lit(False))


def has_number(c: Column) -> Column:
    return ~is_na(c) & c.cast("string").rlike(r"\d")


def is_wild_type(c: Column, allow_empty: bool = True) -> Column:
    return F.when(is_na(c), F.lit(allow_empty)).otherwise(F.lower(F.trim(c)).isin(*WILD_TYPES))


def doi_to_filename(c: Column) -> Column:
    return replace_each(c, {":": "_", "<": "_", ">": "_", "/": "_"})


def filename_to_doi(c: Column) -> Column:
    """The first underscore after the prefix was a slash; others stay, as they can't be told apart."""
    return F.regexp_replace(c, r"^(10\.\d+)_", r"$1/")


def id_parts(c: Column) -> Column:
    """struct(namespace, versioned, pmid) of namespace_version_pmid; fewer parts leave versioned as the whole id."""
    parts = F.split(c, "_", 3)
    return F.struct(parts[0].alias("namespace"), F.substring_index(c, "_", 2).alias("versioned"), F.get(parts, F.lit(2)).alias("pmid"))


def is_valid_namespace(c: Column) -> Column:
    return ~c.rlike(r'[*/\\<>:|?]')


#: Endings of namespaces and the model and output form they stand for.
MODELS = [
    ("-mini", "gpt-4o-mini", False), ("-oneshot", "gpt-4o-2024-05-13", False), ("-4o", "gpt-4o-2024-05-13", False), ("-4os", "gpt-4o-2024-08-06", False),
    ("-4o-str", "gpt-4o-2024-08-06", True), ("-4ostruct", "gpt-4o-2024-08-06", True),
]


def model_of(namespace: Column, tuned: dict[str, str] | None = None) -> Column:
    """struct(model, structured) by the namespace's ending; tuned: endings of fine-tuned models. Other namespaces give null."""
    out = F.lit(None).cast("struct<model:string,structured:boolean>")
    for ending, model, structured in [*MODELS, *((e, m, False) for e, m in (tuned or {}).items())]:
        out = F.when(namespace.endswith(ending), F.struct(F.lit(model).alias("model"), F.lit(structured).alias("structured"))).otherwise(out)
    return out


def explode_field(c: Column) -> Column:
    """Delimited text as a list: '; ' if it stands there, else ', '; empty or null gives an empty list."""
    parts = F.when(c.contains("; "), F.split(c, "; ")).otherwise(F.split(c, ", "))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def yaml_blocks(c: Column) -> Column:
    """All fenced YAML blocks."""
    return F.regexp_extract_all(c, F.lit("(?s)```yaml\\n(.*?)```"), F.lit(1))


def first_yaml(c: Column) -> Column:
    """struct(before, block, after) of the first fenced block, null if there is none that ends."""
    p = "(?s)^(.*?)```yaml\\n(.*?)```(.*)$"
    return F.when(c.rlike(p), F.struct(*[F.regexp_extract(c, p, k).alias(n) for k, n in enumerate(("before", "block", "after"), 1)]))


def printed_list(c: Column) -> Column:
    """Items of a printed list of quoted strings."""
    return F.regexp_extract_all(c, F.lit("'([^']*)'"), F.lit(1))


def formula_from_inchi(c: Column) -> Column:
    """The formula layer of an InChI up to its first '-'; other texts null."""
    return F.when(c.startswith("InChI="), F.split_part(F.split_part(c, F.lit("/"), F.lit(2)), F.lit("-"), F.lit(1)))


def recover_ncbi(c: Column) -> Column:
    """The accession of a FASTA descriptor: its first word; of db|id|name the id, or the name if there is no id."""
    head = F.split_part(F.trim(c), F.lit(" "), F.lit(1))
    parts = F.split(head, r"\|")
    inner = F.when(F.size(parts) < 3, None).otherwise(F.coalesce(F.nullif(parts[1], F.lit("")), F.element_at(parts, -1)))
    return F.when(head.contains("|"), inner).otherwise(head)


def substrate_answer(c: Column) -> Column:
    """struct(substrate, search, answer) of an answer sheet; an answer of 'none' is null."""
    grab = lambda name: F.nullif(F.trim(F.regexp_extract(c, rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    answer = grab("Final Answer")
    return F.struct(grab("Substrate").alias("substrate"), grab("Search").alias("search"), F.when(F.lower(answer) != "none", answer).alias("answer"))


def identifiers(c: Column) -> Column:
    """struct of distinct accessions found in a text: pdb (with a letter), uniprot, refseq, genbank."""

    def found(pattern: str, group: int) -> Column:
        return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group))))

    black = F.array(*[F.lit(x) for x in NOT_UNIPROT])
    return F.struct(
        F.filter(found(PDB, 0), lambda x: x.rlike("[A-Za-z]")).alias("pdb"), F.array_except(found(UNIPROT, 0), black).alias("uniprot"),
        found(REFSEQ, 1).alias("refseq"), found(GENBANK, 1).alias("genbank"),
    )


def lengthened(short: Column, longer: Column) -> Column:
    """A short name (under 10 characters) with its long form: 'long (short)'."""
    return F.when(is_na(short), longer).when(is_na(longer) | (short == longer) | (F.length(short) >= 10), short).otherwise(F.format_string("%s (%s)", longer, short))
