"""Parsers of raw records: XML-like bodies, ontology stanzas, flat records, packed cells and JSON templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T


def looks_like_xml(c: Column) -> Column:
    return F.ltrim(c).startswith("<") & (c.contains("<STUDY") | c.contains("<SAMPLE"))


def attribute_text(c: Column) -> Column:
    """'tag: value; tag: value' of all TAG/VALUE pairs."""
    tags, values = F.regexp_extract_all(c, F.lit("<TAG>([^<]+)</TAG>"), 1), F.regexp_extract_all(c, F.lit("<VALUE>([^<]*)</VALUE>"), 1)
    return F.array_join(F.zip_with(tags, values, lambda t, v: F.concat(F.trim(t), F.lit(": "), F.trim(v))), "; ")


def attribute_map(c: Column) -> Column:
    """map of TAG to VALUE; the first value of a tag stays."""
    pairs = F.zip_with(F.regexp_extract_all(c, F.lit("<TAG>([^<]+)</TAG>"), 1), F.regexp_extract_all(c, F.lit("<VALUE>([^<]*)</VALUE>"), 1), lambda t, v: F.struct(F.trim(t).alias("key"), F.trim(v).alias("value")))
    first = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda a, p: F.when(F.exists(a, lambda x: x["key"] == p["key"]), a).otherwise(F.concat(a, F.array(p))))
    return F.map_from_entries(first)


def block_text(c: Column, tag: str) -> Column:
    """Text of the first element of a tag, markup gone and white space folded."""
    return T.sanitise(F.regexp_replace(F.regexp_extract(c, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", " "))


def sample_accession(c: Column) -> Column:
    """Sample accession: typed link, then external id, then anywhere; else NULL."""
    hit = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(hit("<DB>biosample</DB><ID>(SAMN[0-9]+)</ID>"), hit('namespace="BioSample">(SAMN[0-9]+)<'), hit("(SAMN[0-9]+)"))


def file_key(path: Column, suffix: str) -> Column:
    return F.regexp_extract(path, "([^/]+)" + suffix.replace(".", r"\.") + "$", 1)


def header_projection(header: Column, line: Column, names: list[str]) -> list[Column]:
    """Columns of a delimited line by its header's names; a name that is not there is empty."""
    m = F.map_from_arrays(F.split(header, "\t"), F.split(line, "\t"))
    return [F.coalesce(F.try_element_at(m, F.lit(n)), F.lit("")).alias(n) for n in names]


def obo_terms(stanzas: DataFrame, body: str = "value", prefix: str | None = None) -> DataFrame:
    """(code, name, synonym) of ontology term stanzas that are not obsolete."""
    b = F.col(body)
    rows = stanzas.where(b.contains("id: ") & ~b.contains("is_obsolete: true")).select(
        F.regexp_extract(b, r"(?m)^id: (\S+)", 1).alias("code"), F.trim(F.regexp_extract(b, r"(?m)^name: (.*)$", 1)).alias("name"),
        F.array_join(F.regexp_extract_all(b, F.lit(r'(?m)^synonym: "([^"]*)"'), 1), ";").alias("synonym"))
    return rows.where(F.col("code") != "" if prefix is None else F.col("code").startswith(prefix))


def read_obo(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    return obo_terms(spark.read.option("lineSep", "\n[").text(path), prefix=prefix)


# fixed values: continents in the order in which a share of 80 or more decides
ANCESTRY = (("African", ("African",)), ("Native American", ("Native American",)), ("Asian", ("East Asian, North", "East Asian, South", "South Asian")), ("European", ("European, North", "European, South")))


def ancestry(c: Column, fallback: Column) -> Column:
    """First continent whose summed percentages reach 80, else the fallback population."""
    out = fallback
    for name, parts in reversed(ANCESTRY):
        total = F.lit(0.0)
        for p in parts:
            total = total + F.coalesce(F.regexp_extract(c, rf"{p}=([0-9]+(?:\.[0-9]+)?)%", 1).try_cast("double"), F.lit(0.0))
        out = F.when(total >= 80, name).otherwise(out)
    return out


def biopsy_type(site: Column) -> Column:
    """Biopsy type and organ code of a derivation site such as 'Metastatic; Lung; UBERON=UBERON_0002048.'."""
    organ = F.lower(F.trim(F.split(site, ";")[1]))
    return F.when(site.startswith("Metastatic"), "metastasis").when(site.startswith("In situ"), F.when(organ.contains("blood"), "blood").otherwise("primary")).otherwise("")


def flat_records(records: DataFrame, body: str = "value") -> DataFrame:
    """Entities of '//'-terminated flat records; only records of taxon 9606."""
    b = F.col(body)
    line = lambda k: F.trim(F.regexp_extract(b, rf"(?m)^{k}   (.*)$", 1))
    cc = lambda k: F.trim(F.regexp_extract(b, rf"(?m)^CC   {k}: (.*?)\.?$", 1))
    site = cc("Derived from site")
    return records.where(b.contains("NCBI_TaxID=9606")).select(
        line("AC").alias("id"), line("ID").alias("name"), F.replace(line("SY"), F.lit("; "), F.lit(";")).alias("synonym"),
        F.trim(F.element_at(F.split(line("DI"), ";"), -1)).alias("disease"), line("AG").alias("age"), F.lower(line("SX")).alias("sex"),
        ancestry(cc("Genome ancestry"), cc("Population")).alias("ethnicity"), biopsy_type(site).alias("biopsy_type"),
        F.lower(F.trim(F.coalesce(F.get(F.split(site, ";"), F.lit(1)), F.lit("")))).alias("biopsy_site"), F.regexp_extract(site, "UBERON[_=:]+(?:UBERON_)?([0-9]+)", 1).alias("uberon_code"),
        F.lower(F.trim(F.split(cc("Cell type"), ";")[0])).alias("cell_type"))


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    return flat_records(spark.read.option("lineSep", "\n//\n").text(path))


def template(c: Column) -> tuple[Column, Column]:
    """(text, weight) of a template item: a list [text, n], an object with text, or a bare text."""
    as_list = F.from_json(c, "array<string>")
    as_dict = F.from_json(c, "struct<text:string,template:string,count:string>")
    bare = F.regexp_replace(c, '^"|"$', "")
    text = F.coalesce(F.get(as_list, F.lit(0)), as_dict["text"], as_dict["template"], F.when(~c.rlike(r"^\s*[\[{]"), bare))
    return text, F.coalesce(F.get(as_list, F.lit(1)).try_cast("int"), as_dict["count"].try_cast("int"), F.lit(1))


def lenient_field(c: Column, name: str) -> Column:
    """A field of JSON that may be quoted twice or broken."""
    unquoted = F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.coalesce(F.get_json_object(c, f"$.{name}"), F.get_json_object(unquoted, f"$.{name}"), F.nullif(F.regexp_extract(c, rf'"?{name}"?\s*:\s*"?([^",}}]+)', 1), F.lit("")))


def key_value_lines(c: Column) -> Column:
    """map of 'key: value' lines."""
    keys, values = F.regexp_extract_all(c, F.lit(r"(?m)^([A-Za-z_]+): (.*)$"), 1), F.regexp_extract_all(c, F.lit(r"(?m)^([A-Za-z_]+): (.*)$"), 2)
    return F.map_from_arrays(keys, values)
