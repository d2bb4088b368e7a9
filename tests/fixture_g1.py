"""Twelve reports and the statistics of their ten cells, computed by hand from the formulas."""

ROWS = [
    ("drugA", "headache", "2020-03-01", 6), ("drugA", "headache", "2021-05-02", 4), ("drugA", "nausea", "2020-07-09", 3),
    ("drugA", "rash", "2021-01-15", 1), ("drugB", "headache", "2020-11-30", 2), ("drugB", "nausea", "2020-02-02", 8),
    ("drugB", "nausea", "2022-06-01", 4), ("drugB", "rash", "2022-09-09", 5), ("drugC", "headache", "2021-08-20", 7),
    ("drugC", "nausea", "2022-03-03", 2), ("drugC", "rash", "2022-12-31", 11), ("drugD", "rash", "2022-04-04", 3),
]

NAMES = ("E", "PRR", "p_prr", "PRRlb", "ROR", "p_ror", "RORlb", "fish", "fish_cut", "post", "IClb", "post_gps", "EBlog2", "EB05")
CELLS = {
    ("headache", "drugA"): (4.75, 3.333333, 0.000202, 0.536799, 9.166667, 0.000787, 0.841621, 0.001158, 0.001381, 0.066920, -0.270556, 0.052680, 0.748136, 0.9910),
    ("headache", "drugB"): (6.446429, 0.229102, 0.983364, -2.830308, 0.138408, 0.992244, -3.579027, 0.999168, 0.999355, 0.945593, -3.437391, 0.981643, -1.515941, 0.1215),
    ("headache", "drugC"): (6.785714, 1.05, 0.449610, -0.706274, 1.076923, 0.449783, -1.076743, 0.563046, 0.591865, 0.521470, -1.241665, 0.571455, -0.119807, 0.4959),
    ("nausea", "drugA"): (4.25, 0.642857, 0.786450, -1.532256, 0.545455, 0.797156, -2.034875, 0.881987, 0.892056, 0.745198, -2.268648, 0.806253, -0.634026, 0.2629),
    ("nausea", "drugB"): (5.767857, 4.673684, 0.000317, 0.657409, 10.971428, 0.000199, 1.069686, 0.000243, 0.000303, 0.046403, -0.149707, 0.034142, 0.780593, 1.0600),
    ("nausea", "drugC"): (6.071429, 0.24, 0.979377, -2.797535, 0.155556, 0.988503, -3.464862, 0.998421, 0.998744, 0.935998, -3.371786, 0.975747, -1.447988, 0.1275),
    ("rash", "drugA"): (5.0, 0.157895, 0.970383, -3.763583, 0.093117, 0.985804, -4.496665, 0.999346, 0.999467, 0.946512, -4.350535, 0.984481, -1.868031, 0.0709),
    ("rash", "drugB"): (6.785714, 0.649123, 0.841171, -1.279709, 0.523810, 0.851781, -1.860460, 0.912562, 0.924008, 0.755571, -1.838298, 0.819455, -0.542104, 0.3341),
    ("rash", "drugC"): (7.142857, 2.2, 0.012647, 0.097608, 3.666667, 0.014058, 0.139474, 0.025907, 0.030520, 0.162511, -0.514976, 0.159584, 0.415343, 0.8085),
    ("rash", "drugD"): (1.071429, 3.117647, 0.0, 0.745303, None, None, None, 0.041126, 0.043453, 0.244279, -1.381835, 0.241977, 0.500391, 0.5634),
}
PRR_FDR = (0.0, 0.000344, 0.000359, 0.010743, 0.305533, 0.339775, 0.449813, 0.528411, 0.587360, 0.633209)
FISHER_FDR = (0.000652, 0.001552, 0.023145, 0.027556, 0.335021, 0.468017, 0.556680, 0.620012, 0.667510, 0.704454)
BCPNN_FDR = (0.066920, 0.506256, 0.511328, 0.569795, 0.465117, 0.543597, 0.601156, 0.620458, 0.569575, 0.537045)
BCPNN_FDR_SORTED = (0.046403, 0.056661, 0.091945, 0.130028, 0.208317, 0.297797, 0.363193, 0.434794, 0.491549, 0.537045)
POISSON = (4.874850, 6.294819, 6.625027, 4.767207, 6.155822, 6.478739, 4.929579, 6.365490, 6.699405, 2.809062)
NB = (4.892457, 6.259465, 6.575658, 4.848149, 6.202776, 6.516106, 4.914763, 6.288003, 6.605638, 2.858119)
PRIOR = (0.2041, 0.05816, 1.415, 1.838, 0.0969)
