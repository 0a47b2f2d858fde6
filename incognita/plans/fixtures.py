"""Texts, annotations and mappings that the queries add to the tables, so that every operator has something to find.

The same rows are built in Spark and written as VALUES in the reference SQL.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DOCS = [
    (-1, "Contact : a.b@ex.fr ou 06.12.34.56.78"),
    (-2, "Tel 115 et 3646, puis +33 6 12 34 56 78 ; admis en 1978"),
    (-3, "Un EHPAD du quartier ; le SAAD passe"),
    (-4, "L'EHPAD Sainte-Gertrude accueille"),
    (-5, "SESSAD « Arc-en-Ciel »"),
    (-6, "la CAF de Paris. Puis la MDPH de Lyon 3"),
    (-7, "avec ARS hier ; CAF, puis CAF."),
    (-8, "le Conseil Départemental, hier ; chez Google"),
    (-9, "vu par Dr LEMOINE, puis par Dr. LEMOINE"),
    (-10, "habite 59800 Lille, avenue Foch, et vient de Lyon"),
    (-11, "SS: 1 65 03 75 123 456 78 et l’URSSAF – Pôle emploi"),
    (-12, "le CHU Nantes et le CHU, mas Les Tilleuls à côté"),
    (-13, "Jean DUPONT suit l'association Les Amis Du Parc, Fondation Truc"),
    (-14, "ESAT Massy et IME Les Lilas, au foyer de vie Les Roses"),
    (-15, "Le CCAS `local` “cite” l’ADMR… école du Moulin, rue de l"),
    (-16, "Tribunal Judiciaire de Créteil ; TJ Bobigny ; Habitat 33 ; Terres & Toits 17"),
    (-17, "CMPP Pasteur, CMP, Mission Locale du Nord, psychologue CAF psychologue"),
    (-18, ""),
    (-19, "à  l'accueil de jour Alzheimer ;\n\n\n\tGEM   Orion, SA HLM, résidence Autonomie"),
    (-20, "EHPAD Les Ormes, EHPAD Les Ormes ; 0612345678 0612345678"),
]
#: (doc_id, start, end, label, score) in the normalized text.
NER = [
    (-4, 8, 23, "LOC", 0.9),
    (-5, 8, 20, "LOC", 0.8),
    (-9, 10, 17, "PER", 0.95),
    (-9, 32, 39, "PER", 0.95),
    (-10, 7, 18, "LOC", 0.9),
    (-10, 20, 31, "LOC", 0.7),
    (-10, 45, 49, "LOC", 0.9),
    (-12, 3, 13, "ORG", 0.8),
    (-12, 20, 23, "ORG", 0.8),
    (-12, 29, 41, "LOC", 0.6),
    (-13, 0, 11, "ORG", 0.6),
    (-14, 0, 10, "LOC", 0.9),
    (-14, 18, 27, "PER", 0.7),
    (-14, 45, 54, "LOC", 0.7),
    (-15, 0, 2, "LOC", 0.3),
    (-16, 22, 29, "LOC", 0.9),
    (-17, 5, 12, "PER", 0.9),
    (-20, 6, 15, "LOC", 0.9),
    (-20, 23, 32, "LOC", 0.9),
]
#: A mapping of an earlier run, for every document alike: original, alias, prefix, n.
KNOWN = [("CAF de Paris", "<ORG_CAF_1>", "ORG_CAF", 1), ("115", "<PHONE_7>", "PHONE", 7)]
#: Dates and times have no shipped rules; these stand for a user's.
EXTRA_RULES = {"date_regex": {"DATE": [r"\b\d{1,2}/\d{1,2}/\d{4}\b"]}, "time_regex": {"TIME": [r"\b\d{1,2}h\d{2}\b"]}}
EXTRA_DOCS = [
    (-21, "le 12/03/2021 à 14h30, puis 1/2/2022 vers 9h05"),
    (-22, "la PrÃ©fecture, la SociÃ©tÃ© GÃ©nÃ©rale du Nord, un Ã‰SAT ; HÃ´pital Nord, Croix-Rouge franÃ§aise, la Préfecture"),
]
#: Files as users write them, and what is read from them.
CSV = {
    "gazetteer_untidy": 'name,category,reason\n  Foyer Bleu ,ETAB_MAS , x\n"Dupont, Fils",ORG_X,\n,ORG_Y,no name\nNom,,no category\n',
    "keywords": "category,keyword\nORG_Z, Vert\n",
    "other": "word\nx\n",
}
CSV_ENTRIES = [("gazetteer_untidy", "Foyer Bleu", "ETAB_MAS"), ("gazetteer_untidy", "Dupont, Fils", "ORG_X"), ("keywords", "Vert", "ORG_Z")]
YAML = """\ufeff# rules of a user
date_regex:
  DATE: ['\\b\\d{1,2}/\\d{1,2}/\\d{4}\\b', '(']
  EMPTY:
time_regex: {TIME: ["\\\\b\\\\d{1,2}h\\\\d{2}\\\\b"]}
profession_regex: {JOB: ['chef']}
org_regex:
  ORG_CAF: ['\\bCAF du \\d+\\b']
  ORG_OWN: ['[', '\\bOwn\\b', '\\bMine\\b']
"""
#: family, categories and patterns in force with these rules beside the shipped ones.
RULES = [("org_regex", 54, 120), ("etab_categories", 42, 71), ("date_regex", 1, 1), ("phone_regex", 1, 3), ("nir_regex", 1, 1), ("time_regex", 1, 1), ("email_regex", 1, 1)]
JSON = '{"reverse": {}, "forward": {"CAF de Paris": "<ORG_CAF_1>",\n  "115": "<PHONE_7>", "caf\\u00e9 \\"x\\"": "<ETAB_A_12>"}}'
JSON_ENTRIES = [*KNOWN, ('café "x"', "<ETAB_A_12>", "ETAB_A", 12)]
DOCX = ["<w:r><w:t>Premier</w:t></w:r>", "", "<w:r><w:t>Deux</w:t><w:tab/><w:t>mots &amp; </w:t></w:r><w:r><w:t>fin</w:t><w:br/></w:r>"]
DOCX_TEXTS = [("a.docx", "Premier\n\nDeux\tmots & fin\n"), ("b.docx", None)]


def docx() -> bytes:
    """The fixture's DOCX file."""
    out = io.BytesIO()
    body = "".join(f"<w:p>{p}</w:p>" for p in DOCX)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def leading_word() -> Callable[[list[str]], list[list[dict]]]:
    """Loads what stands for a model: it takes the letters that a chunk begins with for a person."""

    def model(texts: list[str]) -> list[list[dict]]:
        found = [re.match("[A-Za-z]+", t) for t in texts]
        return [[{"entity_group": "PER", "start": 0, "end": m.end(), "score": 0.5}] if m else [] for m in found]

    return model


def documents(spark: SparkSession) -> DataFrame:
    """doc_id, text of the fixture documents."""
    return spark.createDataFrame(DOCS + EXTRA_DOCS, "doc_id long, text string")


def annotations(spark: SparkSession) -> DataFrame:
    """The annotations of the fixture documents."""
    return spark.createDataFrame(NER, "doc_id long, start int, end int, label string, score double")
