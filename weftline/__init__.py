"""Weftline: a PySpark-native engine for ordering very large line records."""

from weftline.options import GeneratorOptions, SortOptions
from weftline.plans.files import generate_file, sort_file
from weftline.plans.strategy import choose_strategy

__all__ = ["GeneratorOptions", "SortOptions", "choose_strategy", "generate_file", "sort_file"]
