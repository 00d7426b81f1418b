"""Small dimension tables: organelles, their fine classes, palettes, prompt texts and backend defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Keys, names, colours and classes that prompts, masks and catalogs are matched by.
ORGANELLES = [
    ("mito", "mitochondria", "bright red", 255, 0, 0),
    ("er", "endoplasmic reticulum", "bright green", 0, 255, 0),
    ("nucleus", "nucleus", "bright blue", 0, 0, 255),
    ("lipid_droplet", "lipid droplets", "bright yellow", 255, 255, 0),
    ("plasma_membrane", "plasma membrane", "bright cyan", 0, 255, 255),
    ("nuclear_envelope", "nuclear envelope", "bright magenta", 255, 0, 255),
    ("nuclear_pore", "nuclear pores", "bright orange", 255, 128, 0),
    ("nucleolus", "nucleolus", "bright purple", 128, 0, 255),
    ("heterochromatin", "heterochromatin", "bright spring green", 0, 255, 128),
    ("euchromatin", "euchromatin", "bright rose", 255, 0, 128),
    ("cell", "cells", "bright red", 255, 0, 0),
]
FINE_CLASSES = {
    "mito": ["mito_mem", "mito_lum", "mito_ribo"],
    "er": ["er_mem", "er_lum", "eres_mem", "eres_lum"],
    "nucleus": ["ne_mem", "ne_lum", "np_out", "np_in", "hchrom", "echrom", "nucpl"],
    "lipid_droplet": ["ld_mem", "ld_lum"],
    "plasma_membrane": ["pm"],
    "nuclear_envelope": ["ne_mem", "ne_lum"],
    "nuclear_pore": ["np_out", "np_in"],
    "nucleolus": [],
    "heterochromatin": ["hchrom"],
    "euchromatin": ["echrom"],
}
INSTANCE_COLORS = [
    (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0),
    (255, 0, 255), (0, 255, 255), (255, 128, 0), (128, 0, 255),
    (0, 255, 128), (255, 128, 128), (128, 255, 128), (128, 128, 255),
]
SYNONYMS = {
    "mito": ["oval", "circle", "organelle", "mitochondrion", "ellipse"],
    "er": ["membrane", "tubule", "network", "reticulum"],
    "nucleus": ["nucleus", "oval", "circle", "cell nucleus"],
    "lipid_droplet": ["droplet", "sphere", "circle", "vesicle"],
    "plasma_membrane": ["membrane", "cell boundary", "border"],
    "nuclear_envelope": ["nuclear membrane", "membrane", "envelope"],
    "nuclear_pore": ["pore", "ring", "dot"],
    "nucleolus": ["nucleolus", "sphere", "dense body"],
    "heterochromatin": ["dark region", "dense chromatin", "chromatin"],
    "euchromatin": ["light region", "diffuse chromatin", "chromatin"],
    "cell": ["cell", "oval", "blob"],
}
PROMPT_TEMPLATES = [
    "Color all the {name} in {color_name}. Keep everything else unchanged.",
    "Highlight the {name} in {color_name}. Do not change anything else.",
    "Paint all {name} {color_name}. Leave everything else as is.",
    "Mark the {name} with {color_name}. Keep the rest unchanged.",
    "Color every {name} {color_name}. Do not modify the background.",
]
MULTI_TEMPLATES = [
    "Color {instructions}. Keep everything else unchanged.",
    "Highlight {instructions}. Do not change anything else.",
    "Paint {instructions}. Leave everything else as is.",
    "Mark {instructions}. Keep the rest unchanged.",
]
PREAMBLE = "This is an EM image of cell(s)."
RESOLUTION = "The image resolution is {nm}nm/px."
BODIES = {
    "semantic": "Create a segmentation mask: color all the {name} in {color_name} and make everything else black.",
    "direct": "Create a segmentation mask: show only the {name} in white on a completely black background. Nothing else should be visible.",
    "invert": "Create a segmentation mask: color the background and edges between {name} in white on a completely black background. The {name} interiors should be black, only the boundaries and space between them should be white.",
    "instance": "Color each individual {name} a different unique bright color to distinguish separate instances. Keep everything else unchanged.",
    "instance_direct": "Color each individual {name} a different unique bright color to distinguish separate instances. Make everything else completely black.",
}
#: backend -> parameter -> (lowest, highest) of the tunable parameters.
TUNABLE = {
    "flux": {"strength": (0.3, 1.0), "guidance_scale": (1.0, 30.0), "num_inference_steps": (15, 50)},
    "glm": {"guidance_scale": (1.0, 10.0), "num_inference_steps": (20, 100)},
    "qwen": {"guidance_scale": (0.5, 10.0), "num_inference_steps": (20, 80)},
    "gemini": {},
    "sam3": {},
}
#: backend -> defaults (steps, guidance, strength) that replace the "unset" marks 28, 3.5 and 0.75.
BACKEND_DEFAULTS = {"flux": (28, 3.5, 0.75), "glm": (50, 1.5, None), "gemini": (28, 3.5, None), "qwen": (40, 1.0, None), "sam3": (1, 1.0, None)}
UNSET = (28, 3.5, 0.75)
STEP_FRACTION = 0.05
# End of fixed values.


def organelles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ORGANELLES, "organelle_key string, name string, color_name string, r int, g int, b int")


def fine_classes(spark: SparkSession) -> DataFrame:
    """organelle_key, ordinal, cls_name: the bridge from organelles to fine classes."""
    rows = [(k, i, c) for k, v in FINE_CLASSES.items() for i, c in enumerate(v)]
    return spark.createDataFrame(rows, "organelle_key string, ordinal int, cls_name string")


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(INSTANCE_COLORS)], "slot int, pr int, pg int, pb int")
