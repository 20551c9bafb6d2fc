"""Weak labels of a sample from its free text and attributes: one label per field, NULL where nothing speaks for one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import first_class, phrase_pattern, spaced

# fixed values: phrases of each class, in the order in which classes win; ~ is a place where a separator may stand, the last of a
# pair lies up to 10 characters behind the first
LIBRARY = {
    "polyA": ("polya", "poly~a", "oligo~dt", "truseq~stranded~mrna", "truseq~mrna", "standard~mrna", "smarter~mrna", "stranded~mrna"),
    "inverse rRNA": ("ribominus", "ribo~dep", "ribo~zero", "riboerase", "ribogone", "ribocop", "ribo~mi", ("deplet", ("ribosom",)), "remove ribosom",
                     "truseq~stranded~total", "truseq~total", "smarter~stranded~total", "smarter~total", "total rna"),
    "hybrid selection": ("hybrid~selection", "exon~capture", "exome~capture", "rna~exome", "geomx", "hybrid capture", "capture rna", "bait"),
    "small RNA": ("truseq~small", "small~rna", "size~fraction", "mirna", "pi~rna"),
}
SOURCE = {
    "single_cell": ("scrna", "snrna", "smart~seq", "single~cell", "single~nucleus", "cite~seq", "drop~seq", "10x", "cell~ranger"),
    "spatial": ("spatial", "visium", "slide~seq", "stereo~seq", "merfish", "seqfish", "cosmx", "xenium", "geomx"),
}
# fixed values: whole words of each class, in the order in which classes win
ORGAN = {
    "lung": ("lung",), "liver": ("liver",), "breast": ("breast",), "prostate": ("prostate",), "colon": ("colon", "colorectal"), "kidney": ("kidney", "renal"),
    "brain": ("brain", "glioblastoma", "cortex", "cerebellum"), "pancreas": ("pancreas", "pancreatic"), "ovary": ("ovary", "ovarian"), "stomach": ("stomach", "gastric"),
    "skin": ("skin", "dermal", "melanoma"), "heart": ("heart", "cardiac"), "muscle": ("muscle", "myocard"), "spleen": ("spleen",), "thyroid": ("thyroid",),
    "esophagus": ("esophagus", "esophageal"), "uterus": ("uterus", "endometrium", "endometrial"), "cervix": ("cervix", "cervical"), "bladder": ("bladder", "urothelial"),
    "bone_marrow": ("bone marrow",), "blood": ("blood",),
}
BIOPSY = {
    "metastasis": ("metastasis", "metastatic", "met", "mets"), "blood": ("pbmc", "peripheral blood", "whole blood", "blood", "plasma", "serum"), "primary": ("primary",),
}
RESPONSE = {
    "stable_disease": ("stable disease", "sd"), "partial_response": ("partial response", "pr"), "complete_response": ("complete response", "cr"),
    "progressive_disease": ("progression", "progressive disease", "pd"), "non_responder": ("non responder", "nonresponder", "nr"), "responder": ("responder",),
}
SEX = {"female": ("female", "f"), "male": ("male", "m")}
HEALTHY = ("healthy", "normal", "control", "wild type", "wildtype")
UNTREATED = ("untreated", "vehicle", "control", "dmso")
TREATED = ("treated with", "treatment with", "administered", "exposure to", "received")
# fixed values: words that speak of cancer anywhere in a word, and a word's end that does
CANCER = ("carcinoma", "cancer", "leukemia", "lymphoma", "myeloma", "melanoma", "sarcoma", "glioblastoma", "tumor", "tumour", "neoplasm", "adenocarcinoma")
CANCER_END = "oma"
NOT_CANCER = ("non~cancer", "benign")
ORIGINS = ("caucasian", "european", "african", "asian", "hispanic", "latino", "han", "yoruba", "ashkenazi")

SPAN = r"[0-9]+ *(?:days?|hours?|weeks?|months?|mos?|d|h|w)(?![a-z])"
AGE = r"(?:age[^0-9]{0,6})?[0-9]{1,2} *(?:years?|yrs?|yo|y|ans)(?![a-z])"
_CANCER = phrase_pattern(CANCER, "") + rf"|{CANCER_END}(?![a-z])"


def _words(*phrases: str) -> str:
    """Pattern of whole words over spaced() text."""
    return " (?:" + "|".join(p.replace(" ", "  ") for p in phrases) + ") "


def _by_words(text: Column, classes: dict[str, tuple]) -> Column:
    return first_class(text, [(name, _words(*p)) for name, p in classes.items()], None)


def _by_phrases(text: Column, classes: dict[str, tuple]) -> Column:
    return first_class(text, [(name, phrase_pattern(p, r"[.\s-]?")) for name, p in classes.items()], None)


def _found(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(text, pattern, 0)
    return F.when(hit != "", hit)


def weak_labels(text: Column, attributes: dict[str, Column] | None = None) -> dict[str, Column]:
    """Label columns by field, from text and, where they are given and not blank, attributes.

    Attributes: tissue, host_site, cell_type, disease, library_selection, library_strategy, age, sex, host_sex, country, latitude,
    longitude, place, origin. A stated attribute goes before what the text says; a library that is stated but of no class is
    'other', a strategy without a sign of single cells or space is 'bulk'. All labels are lower-case but the library's.
    """
    given = attributes or {}
    none = F.lit(None).cast("string")

    def attr(name: str) -> Column:
        v = F.trim(F.lower(given[name])) if name in given else none
        return F.when(v != "", v)

    low = F.lower(F.coalesce(text, F.lit("")))
    flat = spaced(low)
    strategy = attr("library_strategy")
    sick = low.rlike(_CANCER)
    well = flat.rlike(_words(*HEALTHY))
    disease = attr("disease")
    place = F.when(attr("latitude").isNotNull() & attr("longitude").isNotNull(), F.concat(attr("latitude"), F.lit(","), attr("longitude")))
    origin = attr("origin")
    return {
        "library_selection": F.coalesce(_by_phrases(low, LIBRARY), F.when(attr("library_selection").isNotNull(), "other")),
        "sequencing_source": F.coalesce(_by_phrases(F.concat_ws(" ", strategy, low), SOURCE), F.when(strategy.isNotNull(), "bulk")),
        "biopsy_site": attr("tissue"),
        "biopsy_type": _by_words(flat, BIOPSY),
        "cell_type": attr("cell_type"),
        "organ": _by_words(spaced(F.concat_ws(" ", attr("tissue"), attr("host_site"), low)), ORGAN),
        "disease": F.coalesce(disease, F.when(well, "control").when(sick, "cancer")),
        "is_cancer": F.when(disease.isNotNull(), F.when(disease.rlike(_CANCER) & ~disease.rlike(phrase_pattern(NOT_CANCER, "[ -]?")), "true").otherwise("false"))
                      .when(sick, "true").when(well, "false"),
        "treatment": F.when(flat.rlike(_words(*UNTREATED)), "control").when(low.rlike(phrase_pattern(TREATED, "")) | low.rlike(SPAN + "[^a-z]*treat"), "treated"),
        "treatment_time": _found(low, SPAN),
        "response": _by_words(flat, RESPONSE),
        "age": F.coalesce(attr("age"), _found(low, AGE)),
        "sex": F.coalesce(attr("sex"), attr("host_sex"), _by_words(flat, SEX)),
        "ethnicity": F.coalesce(attr("country"), F.when(spaced(origin).rlike(_words(*ORIGINS)), origin)),
        "localization": F.coalesce(place, attr("place"), origin),
    }
