"""What a benchmark runs: documents by class, parser specs and retrieval combinations by preset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Benchmark documents by class, each with the file that holds its truth.
TEXT_DOCUMENTS = ("text_only.pdf",)
TABLE_DOCUMENTS = ("table_native.pdf", "table_image.pdf", "table_image_200dpi.pdf", "table_image_150dpi.pdf", "table_image_72dpi.pdf")
GRAPH_DOCUMENTS = ("graph_rich.pdf", "graph_rich_image.pdf", "graph_rich_image_200dpi.pdf", "graph_rich_image_150dpi.pdf", "graph_rich_image_72dpi.pdf")
TRUTHS = {"text_only.md": TEXT_DOCUMENTS, "table_native.md": TABLE_DOCUMENTS, "graph_rich.md": GRAPH_DOCUMENTS}
DOCUMENTS = TEXT_DOCUMENTS + TABLE_DOCUMENTS + GRAPH_DOCUMENTS
#: Backends of each parsing preset.
PARSING = {
    "quick": (("pymupdf", "docling"), TEXT_DOCUMENTS),
    "phase1": (("pymupdf", "docling"), DOCUMENTS),
    "vlm": (("openai", "upstage", "upstage-enhanced"), DOCUMENTS),
    "upstage-only": (("upstage", "upstage-enhanced"), DOCUMENTS),
    "ocr": (("paddleocr-vl",), DOCUMENTS),
    "deepseek": (("deepseek-ocr2",), DOCUMENTS),
    "vlm-all": (("openai", "upstage", "upstage-enhanced", "paddleocr-vl", "deepseek-ocr2"), DOCUMENTS),
    "phase2": (("pymupdf", "docling", "openai", "openai-4.1", "upstage", "upstage-enhanced", "paddleocr-vl", "deepseek-ocr2"), DOCUMENTS),
    "tables": (("pymupdf", "docling"), TABLE_DOCUMENTS),
    "graphs": (("pymupdf", "docling"), GRAPH_DOCUMENTS),
}
#: Known models of the first two retrieval layers, and the layers of each retrieval preset.
DENSE = ("kosimcse", "e5", "bge-m3", "snowflake-ko", "openai-large", "upstage")
SPARSE = ("korean_bm25", "splade")
LAYERS = ("dense", "sparse", "reranker", "llm_support")
RETRIEVAL = {
    "quick": (("bge-m3",), ("korean_bm25",), ("flashrank",), ("contextual",)),
    "standard": (("kosimcse", "e5", "bge-m3", "openai-large", "upstage"), SPARSE, ("flashrank",), ("contextual",)),
    "full": (("kosimcse", "e5", "bge-m3", "openai-large", "upstage"), SPARSE, ("colbert", "flashrank"), ("contextual",)),
    "service": (("kosimcse", "e5", "bge-m3"), SPARSE, ("colbert",), ("contextual",)),
}


def document_class(name: Column) -> Column:
    """text, table or graph by file name; unknown for any other, null too."""
    return F.when(name.isin(*TEXT_DOCUMENTS), "text").when(name.isin(*TABLE_DOCUMENTS), "table").when(name.isin(*GRAPH_DOCUMENTS), "graph").otherwise("unknown")


def resolution_class(name: Column) -> Column:
    """72dpi, 150dpi, 200dpi or image by what the file name holds, else native."""
    out = None
    for dpi in ("72dpi", "150dpi", "200dpi"):
        out = F.when(name.contains(dpi), dpi) if out is None else out.when(name.contains(dpi), dpi)
    return out.when(name.contains("_image") & ~name.contains("dpi"), "image").otherwise("native")


def truth_of(name: Column) -> Column:
    """The file that holds a document's truth, or null."""
    return F.create_map(*[F.lit(x) for truth, names in TRUTHS.items() for n in names for x in (n, truth)])[name]


def parsing_specs(spark: SparkSession, preset: str, mode: str = "direct") -> DataFrame:
    """backend, pdf_name, mode, gt_name and label (at most 63 characters) of every parse that a preset asks for; an unknown preset is refused."""
    if preset not in PARSING:
        raise ValueError(f"unknown preset {preset!r}; there are {', '.join(PARSING)}")
    backends, names = PARSING[preset]
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, backends))).alias("backend"), F.lit(mode).alias("mode")).select("*", F.explode(F.array(*map(F.lit, names))).alias("pdf_name"))
    stem = F.replace(F.replace("pdf_name", F.lit(".pdf"), F.lit("")), F.lit("_"), F.lit("-"))
    return grid.select("backend", "pdf_name", "mode", truth_of(F.col("pdf_name")).alias("gt_name"), F.substring(F.concat_ws("-", "backend", stem, "mode"), 1, 63).alias("label"))


def combinations(spark: SparkSession, layers: str | tuple) -> DataFrame:
    """Every combination of a retrieval preset, or of four tuples of names, with label, retrieval_mode and index_key.

    An unknown preset, an unknown dense or sparse model and an empty name in any layer are refused.
    """
    if isinstance(layers, str):
        if layers not in RETRIEVAL:
            raise ValueError(f"unknown preset {layers!r}; there are {', '.join(RETRIEVAL)}")
        layers = RETRIEVAL[layers]
    for name, found, known in (("dense", layers[0], DENSE), ("sparse", layers[1], SPARSE)):
        if wrong := [x for x in found if x and x not in known]:
            raise ValueError(f"unknown {name} models {wrong}; there are {', '.join(known)}")
    if missing := [name for name, found in zip(LAYERS, layers) if not all(found)]:
        raise ValueError(f"every layer needs a name: {', '.join(missing)}")
    grid = spark.range(1).select()
    for name, found in zip(LAYERS, layers):
        grid = grid.select("*", F.explode(F.array(*map(F.lit, found)).cast("array<string>")).alias(name))
    mode = F.concat(F.lit("hybrid_with_"), F.col("reranker"), F.lit("_rerank_and_llm_support"))
    return grid.select(*LAYERS, F.concat_ws("+", *LAYERS).alias("label"), mode.alias("retrieval_mode"), F.concat_ws(":", "dense", "sparse").alias("index_key"))
