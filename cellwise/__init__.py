"""Disproportionality analysis of product x event reports on Spark DataFrames."""

from cellwise.operators.bayes import bcpnn, gps
from cellwise.operators.binary import convert_binary, convert_multi_item
from cellwise.operators.cells import Cells, convert
from cellwise.operators.expected import calculate_expected, select_alpha, test_dispersion
from cellwise.operators.lasso import lasso
from cellwise.operators.lbe import lbe
from cellwise.operators.longitudinal import LongitudinalModel
from cellwise.operators.ratios import prr, rfet, ror
from cellwise.operators.result import Signals

__all__ = [
    "Cells",
    "LongitudinalModel",
    "Signals",
    "bcpnn",
    "calculate_expected",
    "convert",
    "convert_binary",
    "convert_multi_item",
    "gps",
    "lasso",
    "lbe",
    "prr",
    "rfet",
    "ror",
    "select_alpha",
    "test_dispersion",
]
