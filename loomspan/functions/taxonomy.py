"""Repeat taxonomy: ordered rules from annotation label to class, subclass, order and superfamily.

A rule is a boolean text over terms: =x (exact), ~x (contains), ~i x (contains, any case), ^x (starts with); terms are
joined by & before |. The last matching rule wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = "NA"
RT, DNA, TR = "Retrotransposon", "DNA", "Tandem_repeat"


def _superfamilies(order: str, rules: list[tuple[str, str]]) -> list[tuple[str, tuple]]:
    return [(rule, (RT, NA, order, name)) for rule, name in rules]


# Labels as annotation programs write them, and the taxonomy's names.
RULES: list[tuple[str, tuple]] = [
    ("=__unknown", ("Unclassified", NA, NA, NA)),
    *[(f"={x}", ("Other", x, NA, NA)) for x in ("tRNA", "rRNA", "srpRNA", "snRNA", "scRNA")],
    ("=Simple_repeat", (TR, "Simple_repeat", NA, NA)),
    ("=Satellite", (TR, "Satellite", NA, NA)),
    ("=Satellite/W-chromosome", (TR, "Satellite", "W-chromosome", NA)),
    ("=Satellite/Y-chromosome", (TR, "Satellite", "Y-chromosome", NA)),
    ("~Satellite/acro", (TR, "Satellite", "acromeric", NA)),
    ("~Satellite/centr", (TR, "Satellite", "centromeric", NA)),
    ("~Satellite/macro", (TR, "Satellite", "macro", NA)),
    ("~Low_complexity", ("Other", "Low_complexity", NA, NA)),
    ("~Other", (NA, NA, NA, NA)),
    ("~Retroposon|~__ClassI", (RT, NA, NA, NA)),
    ("~LINE", (RT, NA, "LINE", NA)),
    ("~_LTR|^LTR/|=LTR", (RT, NA, "LTR", NA)),
    ("~SINE", (RT, NA, "SINE", NA)),
    ("~Retroposon&~SVA|~Retroposon&~L1-dep", (RT, NA, NA, "L1-dependent")),
    ("~Retroposon/RTE-derived", (RT, NA, NA, "RTE-derived")),
    ("~LINE&~Penelope|~ClassI&~PLE", (RT, NA, "PLE", "Penelope")),
    *_superfamilies("LINE", [
        ("~LINE/CR1|~LINE/L2|~LINE/Rex-Babar", "CR1"), ("~LINE/CRE", "CRE"), ("~LINE/Deceiver", "Deceiver"),
        ("~LINE/Dong-R4", "Dong-R4"), ("~LINE/I|~nLTR_LINE_I", "I"), ("~LINE/I-Jockey", "Jockey"),
        ("~LINE/L1|~nLTR_LINE_L1", "L1"), ("~LINE/Proto1", "Proto1"), ("~LINE/Proto2", "Proto2"),
        ("~LINE/R1|~LINE/Tad1", "R1"), ("~LINE/R2|~nLTR_LINE_R2", "R2"), ("~LINE/RTE|~nLTR_LINE_RTE", "RTE"),
    ]),
    *_superfamilies("YR", [("~LTR&~DIRS", "DIRS"), ("~LTR&~Ngaro", "Ngaro"), ("~LTR/Viper", "Viper-group")]),
    *_superfamilies("LTR", [
        ("~LTR/Pao|~LTR_BEL", "Bel-Pao"), ("~LTR&~Copia", "Copia"), ("~LTR&~ERV", "ERV"), ("~LTR&~Gypsy", "Gypsy"),
        ("~LTR&~Caulimovirus", "Pararetrovirus"),
    ]),
    *_superfamilies("SINE", [
        ("~SINE&~5S", "5S"), ("~SINE&~7SL|~SINE&~i ALU|~SINE&~B2|~SINE&~B4", "7SL"), ("~Retroposon/L1-derived", "L1-derived"),
        ("~Retroposon/L2-derived", "L2-derived"), ("~SINE&~tRNA", "tRNA"), ("~Retroposon/R4-derived", "R4-derived"),
    ]),
    ("=DNA|=__ClassII", (DNA, NA, NA, NA)),
    ("~DNA&~Crypton", (DNA, "1", "Crypton", "Crypton")),
    ("~DNA&~Zator", (DNA, "1", "TIR", "Zator")),
    ("~ClassII_MITE", (DNA, "1", NA, NA)),
    ("~ClassII_nMITE", (DNA, "1", NA, NA)),
    *[(rule, (DNA, "1", "TIR", name)) for rule, name in [
        ("~DNA&~Academ", "Academ"), ("~DNA&~CMC|~ClassII_DNA_CACTA", "CACTA"), ("~DNA&~Dada", "Dada"),
        ("~DNA&~Kolobok", "Kolobok"), ("~DNA&~Ginger", "Ginger"), ("~DNA&~MULE", "MULE"), ("~DNA&~Merlin", "Merlin"),
        ("~DNA/P", "P"), ("~DNA/PIF|~ClassII_DNA_Harbinger", "PIF-Harbinger"), ("~PiggyBac", "PiggyBac"),
        ("~DNA/Sola", "Sola"), ("~DNA/TcMar|~DNA_TcMar", "TcMar"), ("~DNA&~hAT", "hAT"), ("~DNA_Mutator", "Mutator"),
    ]],
    *[(f"~{x}", (DNA, "1", NA, x)) for x in ("IS3EU", "Novosib", "Zisupton")],
    *[(f"~{x}", (DNA, "2", x, x)) for x in ("Helitron", "Maverick")],
]
MITE_RULES: list[tuple[str, bool]] = [("~_MITE", True), ("~_nMITE", False)]


def _term(label: str, term: str) -> Column:
    c = F.col(label)
    if term.startswith("~i "):
        return F.lower(c).contains(term[3:].lower())
    return {"=": c.__eq__, "~": c.contains, "^": c.startswith}[term[0]](term[1:])


def condition(label: str, rule: str) -> Column:
    every = [reduce(lambda a, b: a & b, [_term(label, t) for t in part.split("&")]) for part in rule.split("|")]
    return reduce(lambda a, b: a | b, every)

