"""Columns added to measurements from name tables, sequence tables, structure tables and answers to follow-up questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.text import doi_to_filename, greek_names
from assayline.operators.joins import best_per_key, first_ignoring_case, join_distances, last_wins, two_sided_names

SEQUENCE_COLUMNS = ["brenda_organism_id", "brenda_uniprot", "enzyme_ident", "enzyme_offset", "amino_acids_checked", "sequence", "sequence_desired", "sequence_desired_at"]


def fill_from_exploded(rows: DataFrame, exploded: DataFrame, keys: tuple[str, ...] = ("descriptor", "pmid"), targets: tuple[str, ...] = ("enzyme", "organism", "substrate", "cofactors")) -> DataFrame:
    """rows with null targets filled from the answer for the same keys; of several answers the first in order counts, so
    the number of rows stays."""
    first = best_per_key(exploded.select(*keys, *targets), list(keys), [F.asc_nulls_last(t) for t in targets])
    for t in targets:
        if t not in rows.columns:
            rows = rows.withColumn(t, F.lit(None).cast(exploded.schema[t].dataType))
    out = rows.join(first.withColumnsRenamed({t: f"__{t}" for t in targets}), list(keys), "left")
    return out.withColumns({t: F.coalesce(t, f"__{t}") for t in targets}).drop(*[f"__{t}" for t in targets])


def add_known_names(names: DataFrame, dictionaries: list[tuple[DataFrame, str]], name: str = "name", short: str = "short_name") -> DataFrame:
    """names with known_name: the name, Greek letters spelled out, if some dictionary has it in any case, else the short
    name on the same condition, else null. Rows without a name stay unknown."""
    words = reduce(DataFrame.unionByName, [d.select(F.lower(c).alias("__w")) for d, c in dictionaries]).filter("__w is not null").distinct()
    found = []
    for k, c in enumerate((name, short)):
        col = f"__known{k}"
        hit = words.select(F.col("__w").alias(f"__w{k}"), F.lit(True).alias(f"__hit{k}"))
        names = names.withColumn(col, greek_names(F.col(c))).join(hit, F.lower(col) == F.col(f"__w{k}"), "left")
        found.append(F.when(F.col(f"__hit{k}"), F.col(col)))
    known = F.when(F.col(name).isNotNull(), F.coalesce(*found))
    return names.withColumn("known_name", known).drop(*[f"{p}{k}" for p in ("__known", "__w", "__hit") for k in (0, 1)])


def add_smiles(names: DataFrame, structures: DataFrame, key: str = "inchi", order: str = "src_file", missing: str = "not found") -> DataFrame:
    """names with the SMILES of their InChI (structures: InChI, Smiles); what a search did not find is null."""
    table = structures.groupBy(F.col("InChI").alias("__i")).agg(F.max_by("Smiles", order).alias("smiles"))
    return names.join(table, F.col(key) == F.col("__i"), "left").drop("__i").withColumn("smiles", F.nullif(F.nullif(F.col("smiles"), F.lit(missing)), F.lit("")))


def first_name(df: DataFrame, columns: list[str]) -> Column:
    """The first of the columns that are there and not null."""
    return F.coalesce(*[F.col(c) for c in columns if c in df.columns])


def add_structures(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with inchi and smiles of their substrate: the trusted side's name, else ours, else the full one, in any case."""
    table = names.filter(F.col("known_name").isNotNull()).groupBy(F.lower("known_name").alias("__k")).agg(F.max(F.struct("inchi", "smiles")).alias("__s"))
    key = F.lower(first_name(rows, ["substrate_2", "substrate", "substrate_full"]))
    return rows.drop("inchi", "smiles").withColumn("__n", key).join(table, F.col("__n") == F.col("__k"), "left").withColumns({"inchi": F.col("__s.inchi"), "smiles": F.col("__s.smiles")}).drop("__n", "__k", "__s")


def infuse_substrates(rows: DataFrame, spellings: DataFrame, substances: DataFrame, structures: DataFrame) -> DataFrame:
    """rows with inchi and smiles. spellings (name): names that a search knows; substances (name, inchi, src_file): a
    dictionary; structures (InChI, Smiles, src_file)."""
    names = first_ignoring_case(two_sided_names(rows, "substrate", "substrate_full"), "name", ["short_name"], F.asc("name"))
    names = add_known_names(names, [(spellings, "name"), (substances, "name")])
    names = last_wins(names, substances, "known_name", "name", "inchi", "src_file")
    return add_structures(rows, add_smiles(names, structures))


def by_preferred_name(rows: DataFrame, table: DataFrame, key: str, wanted: list[str], name: str, columns: list[str], order: Column) -> DataFrame:
    """rows with columns of the key's table row whose name, in any case, is the first of the wanted names that it has."""
    first = best_per_key(table.withColumn("__n", F.lower(name)).filter("__n is not null"), [key, "__n"], [order]).select(key, "__n", *columns)
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    tries = numbered.select("__row", key, F.posexplode(F.array(*[F.lower(c) for c in wanted if c in rows.columns])).alias("__p", "__n")).filter("__n is not null")
    best = tries.join(first, [key, "__n"]).groupBy("__row").agg(F.min_by(F.struct(*columns), "__p").alias("__s"))
    return numbered.drop(*columns).join(best, "__row", "left").select(*[c for c in rows.columns if c not in columns], *[F.col(f"__s.{c}").alias(c) for c in columns])


def add_sequence_columns(rows: DataFrame, sequences: DataFrame, key: str = "pmid", columns: list[str] | None = None) -> DataFrame:
    """rows with a sequence table's columns by (key, enzyme), else by (key, enzyme_full)."""
    columns = columns or [c for c in SEQUENCE_COLUMNS if c in sequences.columns]
    return by_preferred_name(rows, sequences, key, ["enzyme", "enzyme_full"], "name", columns, F.asc("name"))


def infuse_sequences_and_substrates(rows: DataFrame, distances: DataFrame, spellings: DataFrame, substances: DataFrame, structures: DataFrame, columns: list[str]) -> DataFrame:
    """Sequence columns by each key's nearest distance row, then structures by substrate."""
    names = rows.select("pmid", F.col("enzyme").alias("name"), F.col("enzyme_full").alias("full")).filter("name is not null or full is not null").distinct()
    names = names.select("pmid", F.coalesce("full", "name").alias("name"), F.when(F.col("full").isNotNull(), F.col("name")).alias("short_name"))
    near = join_distances(names.withColumnRenamed("name", "enzyme"), distances).withColumnRenamed("enzyme", "name")
    named = near.select("pmid", "name", *columns).unionByName(near.filter("short_name is not null").select("pmid", F.col("short_name").alias("name"), *columns))
    return infuse_substrates(add_sequence_columns(rows, named, "pmid", columns), spellings, substances, structures)


def identifiers_of(idents: DataFrame, uniprot: DataFrame, pdb: DataFrame, ncbi: DataFrame, key: str = "pmid") -> DataFrame:
    """(key, kind, ident, name, organism, sequence, descriptor): what is known of the accessions that a key's rows list.

    idents has texts of accessions joined by ', ' in uniprot, pdb, refseq, genbank. A PDB accession gives every versioned
    entry of its unversioned id; the others their first row.
    """
    some = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("__l")) for k in ("uniprot", "pdb", "refseq", "genbank")]))
    listed = idents.select(key, kinds.alias("s")).select(key, "s.kind", F.explode(F.split("s.__l", ", ")).alias("ident")).filter("ident != ''").distinct()
    null = F.lit(None).cast("string")
    ncbi_rows = best_per_key(ncbi, ["ncbi"], [F.asc("descriptor"), F.asc("sequence")]).select(F.col("ncbi").alias("ident"), null.alias("name"), null.alias("organism"), "sequence", "descriptor")
    uniprot_rows = best_per_key(uniprot, ["uniprot"], [F.asc("enzyme"), F.asc("organism")]).select(F.col("uniprot").alias("ident"), F.col("enzyme").alias("name"), "organism", null.alias("sequence"), null.alias("descriptor"))
    pdb_rows = pdb.select(F.col("pdb_unversioned").alias("__u"), F.col("pdb").alias("__v"), some("sys_name", "name").alias("name"), "organism", some("seq_can", "seq").alias("sequence"), some("descriptor", "name", "sys_name").alias("descriptor"))
    columns = [key, "kind", "ident", "name", "organism", "sequence", "descriptor"]
    out = listed.filter("kind in ('refseq', 'genbank')").join(ncbi_rows, "ident").select(*columns)
    out = out.unionByName(listed.filter("kind = 'uniprot'").join(uniprot_rows, "ident").select(*columns))
    found = listed.filter("kind = 'pdb'").join(pdb_rows, F.lower("ident") == F.col("__u")).withColumn("ident", F.col("__v")).select(*columns)
    return out.unionByName(found.distinct())


def review_texts(yamls: DataFrame, found: DataFrame, key: str = "pmid") -> DataFrame:
    """(key, text): the key's YAML block and a line for each accession that identifiers_of() found, for a reader to compare."""
    line = (
        F.when(F.col("kind") == "genbank", F.format_string("[FASTA %s] %s\n", "ident", F.coalesce("descriptor", F.lit(""))))
        .when(F.col("kind") == "uniprot", F.format_string("[UniProt %s] %s %s\n", "ident", F.coalesce("name", F.lit("")), F.coalesce("organism", F.lit(""))))
        .when(F.col("kind") == "pdb", F.format_string("[PDB %s] %s %s\n", "ident", F.coalesce("name", F.lit("")), F.coalesce("organism", F.lit(""))))
    )
    rank = F.when(F.col("kind") == "genbank", 0).when(F.col("kind") == "uniprot", 1).otherwise(2)
    lines = found.filter("kind != 'refseq'").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "ident", line.alias("l")))), lambda x: x["l"]), "").alias("__lines"))
    head = F.concat(F.lit("\n\n## PMID: "), F.col(key), F.lit("\n```yaml\n"), F.col("yaml"), F.lit("```\n"))
    return yamls.join(lines, key, "left").select(key, F.concat(head, F.coalesce("__lines", F.lit(""))).alias("text"))


def doi_table(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """(doi, pmid, source, doi_filename, preferred, rank) of several (source, table): distinct lower-cased pairs, the first
    source kept; preferred is the pmid, else the doi, and never null."""
    parts = []
    for rank, (source, t) in enumerate(tables):
        pmid = "pmid" if "pmid" in t.columns else "ids.pmid"
        parts.append(t.select(F.lower("doi").alias("doi"), F.col(f"`{pmid}`").cast("string").alias("pmid"), F.lit(source).alias("source"), F.lit(rank).alias("rank")))
    every = reduce(DataFrame.unionByName, parts).groupBy("doi", "pmid").agg(F.min(F.struct("rank", "source")).alias("s"))
    return every.select("doi", "pmid", "s.source", doi_to_filename(F.col("doi")).alias("doi_filename"), F.coalesce("pmid", "doi").alias("preferred"), "s.rank").filter("preferred is not null")


def add_canonical(df: DataFrame, filename: str, dois: DataFrame, default: str | None = None) -> DataFrame:
    """df with canonical: a numeric file name itself, else what its name without .pdf or .xml stands for as a DOI's file
    name, then as a DOI; the last source wins; else the default."""
    last = lambda c: dois.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"__{c}")).agg(F.max_by("preferred", F.struct("rank", "preferred")).alias(f"__by_{c}"))
    low = F.lower(filename)
    out = df.withColumn("__low", low).withColumn("__stem", F.regexp_replace("__low", r"\.(pdf|xml)$", ""))
    out = out.join(last("doi_filename"), F.col("__stem") == F.col("__doi_filename"), "left").join(last("doi"), F.col("__stem") == F.col("__doi"), "left")
    number = lambda c: F.when(F.col(c).rlike(r"^\p{N}+$"), F.col(c))
    found = F.coalesce(number("__low"), "__by_doi_filename", "__by_doi", number("__stem"), F.lit(default).cast("string"))
    return out.withColumn("canonical", found).drop("__low", "__stem", "__doi_filename", "__by_doi_filename", "__doi", "__by_doi")
