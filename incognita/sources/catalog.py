"""The detection rules: families, categories and patterns in the order in which they emit.

Patterns are written with correct French accents. Their status says what the ``faithful`` profile makes of each:
L as written; I accented capitals can't begin a name; A only unaccented spellings match; X matches only texts whose UTF-8
was misread as Windows-1252, as the rule itself was; E is no valid pattern and is left out. The ``repaired`` profile uses all patterns as written. Where both differ otherwise, the faithful
form stands beside it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.spans import AT, DIGITS, MISREAD

#: An initial that may be accented, and the rest of a name.
CAP = "[A-ZÉÈÀÂÎÙÔÇ]"
NAME = rf"{CAP}[\w'\- ]+"
WORD = rf"{CAP}[\w'\-]+"
LONG = rf"{CAP}[A-Za-zÀ-ÖØ-öø-ÿ'\- ]+"


@dataclass(frozen=True)
class Rule:
    """One pattern: every match holds one of ``anchors`` (lower-cased words, or signs), if there are any."""

    seq: int
    family: str
    label: str
    category: str
    pattern: str
    ignore_case: bool
    extend_geo: bool
    anchors: tuple[str, ...]


def _acronyms(*names: str) -> list[tuple[str, str]]:
    return [("L", rf"\b{n}\b") for n in names]


# The rules of each family. An upper-case word alone is the acronym of its category.
ORG = {
    "ORG_CCAS_CIAS": _acronyms("CCAS", "CIAS"),
    "ORG_SIAO": _acronyms("SIAO"),
    "ORG_DEPARTEMENT": [
        ("A", r"\b[Cc]onseil\s+[Dd][ée]partemental\s+\d{1,3}\b"),
        ("A", rf"\b[Cc]onseil\s+[Dd][ée]partemental\s+(?:du|de\s+la|des|de\s+l'|d')\s*{NAME}\b"),
        ("A", r"\bD[ée]partement\s+\d{1,3}\b"),
        ("A", rf"\bD[ée]partement\s+(?:du|de\s+la|des|de\s+l'|d')\s*{NAME}\b"),
    ],
    "ORG_REGION": [
        ("A", rf"\b[Cc]onseil\s+[Rr][ée]gional(?:\s+(?:de|d'|du)\s+{NAME})?\b"),
        ("A", rf"\b[Rr][ée]gion\s+{NAME}(?:[- ]{NAME})*\b"),
        ("A", r"\b[Rr][ée]gion\s+Auvergne[- ]Rh[ôo]ne[- ]Alpes\b"),
    ],
    "ORG_PREFECTURE": [("X", r"\bPréfecture\b"), ("X", r"\bSous[-\s]?préfecture\b")],
    "ORG_JUSTICE": [("I", rf"\bTJ\s+{WORD}\b"), ("I", rf"\bTGI\s+{WORD}\b"), ("L", r"\bTribunal\s+(?:Judiciaire|de\s+Grande\s+Instance)\b")],
    "ORG_DDETS": [("L", r"\bDDETS(?:PP)?\b"), ("P", r"\bDirection\s+d'(?:l')?emploi\b", r"\bDirection\s+d'emploi\b")],
    "ORG_ARS": [*_acronyms("ARS"), ("X", r"\bAgence\s+Régionale\s+de\s+Santé\b")],
    "ORG_ASE": [*_acronyms("ASE"), ("X", r"\bAide\s+Sociale\s+à\s+l[’']Enfance\b")],
    "ORG_PJJ": [*_acronyms("PJJ"), ("L", r"\bProtection\s+Judiciaire\s+de\s+la\s+Jeunesse\b")],
    "ORG_MDPH": [*_acronyms("MDPH"), ("X", r"\bMaison\s+Départementale\s+des\s+Personnes\s+Handicapées\b")],
    "ORG_PMI": [*_acronyms("PMI"), ("L", r"\bProtection\s+Maternelle\s+et\s+Infantile\b")],
    "ORG_CAF": [("L", r"\bCaisse\s+d'Allocations\s+Familiales\b"), *_acronyms("CAF")],
    "ORG_CPAM": [("L", r"\bCaisse\s+Primaire\s+d'Assurance\s+Maladie\b"), *_acronyms("CPAM")],
    "ORG_URSSAF": _acronyms("URSSAF"),
    "ORG_MSA": [*_acronyms("MSA"), ("X", r"\bMutualité\s+Sociale\s+Agricole\b")],
    "ORG_CARSAT": _acronyms("CARSAT"),
    "ORG_CNAV": [*_acronyms("CNAV"), ("L", r"\bCaisse\s+Nationale\s+d'Assurance\s+Vieillesse\b")],
    "ORG_POLE_EMPLOI": [("X", r"\bPôle\s+emploi\b")],
    "ORG_AGIRC_ARRCO": [("L", r"\bAGIRC[-\s]?ARRCO\b")],
    "ORG_CHU_CH": [
        *_acronyms("CHU"),
        ("L", r"\bCentre\s+Hospitalier\b"),
        *_acronyms("CHR"),
        ("I", rf"\bCHU\s+(?:de\s+)?{WORD}(?:\s+{WORD}){{0,2}}\b"),
        ("I", rf"\b(?:Centre\s+Hospitalier|CHR)\s+(?:de\s+)?{WORD}(?:\s+{WORD}){{0,2}}\b"),
        ("X", rf"\bHôpit(?:al|aux)\s+{WORD}(?:\s+{WORD}){{0,3}}\b"),
    ],
    "ORG_EPSM": [*_acronyms("EPSM"), ("X", r"\bÉtablissement\s+Public\s+de\s+Santé\s+Mentale\b")],
    "ORG_CMP": [*_acronyms("CMP"), ("X", r"\bCentre\s+Médico\s+Psychologique\b")],
    "ORG_CMPP": [*_acronyms("CMPP"), ("X", r"\bCentre\s+Médico\s+Psycho\s+Pédagogique\b")],
    "ORG_CATTP": [*_acronyms("CATTP"), ("X", r"\bCentre\s+d’Accueil\s+Thérapeutique\s+à\s+Temps\s+Partiel\b")],
    "ORG_CSAPA": [*_acronyms("CSAPA"), ("X", r"\bCentre\s+de\s+Soin\s+d’Accompagnement\s+et\s+de\s+Prévention\s+en\s+Addictologie\b")],
    "ORG_CAARUD": [*_acronyms("CAARUD"), ("X", r"\bCentre\s+d’Accueil\s+et\s+d’Accompagnement\s+à\s+la\s+Réduction\s+des\s+Risques\b")],
    "ORG_PASS": [*_acronyms("PASS"), ("X", r"\bPermanence\s+d’Accès\s+aux\s+Soins\s+de\s+Santé\b")],
    "ORG_MDA": [*_acronyms("MDA"), ("L", r"\bMaison\s+des\s+Adolescents\b")],
    "ORG_CAMSP": [*_acronyms("CAMSP"), ("X", r"\bCentre\s+d[’']Action\s+Médico\s+Sociale\s+Précoce\b")],
    "ORG_CHRS": [*_acronyms("CHRS"), ("X", r"\bCentre\s+d[’']Hébergement\s+et\s+de\s+Réinsertion\s+Sociale\b")],
    "ORG_CADA": [*_acronyms("CADA"), ("L", r"\bCentre\s+d'Accueil\s+de\s+Demandeurs\s+d'Asile\b")],
    "ORG_HUDA": [*_acronyms("HUDA"), ("X", r"\bHébergement\s+d[’']Urgence\s+pour\s+Demandeurs\s+d[’']Asile\b")],
    "ORG_PRAHDA": _acronyms("PRAHDA"),
    "ORG_CAO": [*_acronyms("CAO"), ("L", r"\bCentre\s+d'Accueil\s+et\s+d'Orientation\b")],
    "ORG_MISSION_LOCALE": [
        ("L", r"\bMission\s+Locale\b"),
        ("P", rf"\bMission\s+Locale\s+(?:de|du|d')\s+{NAME}\b", r"\bMission\s+Locale\s+(?:de|du|d')\s+[A-Z][\w'\- ]+\b"),
        ("L", r"\bMaison\s+de\s+l'Emploi\b"),
    ],
    "ORG_SAD": [
        *_acronyms("ADMR"),
        ("A", rf"\b[Ss]ervice\s+d'?[Aa]ide\s+(?:et\s+d'?[Aa]ccompagnement\s+)?[àa]\s+[Dd]omicile\s+{NAME}\b"),
        ("A", rf"\b[Ss]ervices?\s+[àa]\s+la\s+personne\s+{NAME}\b"),
    ],
    "ORG_BAILLEUR_SOC": [
        ("E", rf"\bOPH(?:\s+de\s+{LONG})?\b"),
        *_acronyms("OPAC", "OPHLM"),
        ("L", r"\b(?:Office|Offices?)\s+Public(?:s)?\s+d'Habitat\b"),
        *_acronyms("ESH"),
        ("L", r"\bS(?:A|A\.?)\s*HLM\b"),
        ("L", r"\bCDC\s+Habitat\b"),
        ("L", r"\bHabitat\s+\d{2}\b"),
        ("E", rf"\bHabitat\s+{LONG}\b"),
        *_acronyms("HLM"),
    ],
    "ORG_ENTREPRISE_PRIV": [("P", r"\b(?:Carrefour|Auchan|Casino|Monoprix|Franprix|Intermarch[ée])\b", r"\b(?:Carrefour|Auchan|Casino|Monoprix|Franprix|Intermarche)\b")],
    "ORG_FINANCIER": [
        ("L", r"\bBanque\s+(?:Populaire|Postale|Palatine|Tarneaud|Courtois|\w+)\b"),
        ("X", r"\bCrédit\s+(?:Mutuel|Agricole|Coopératif)\b"),
        ("X", r"\bSociété\s+Générale\b"),
        ("L", r"\bBNP\s+Paribas\b"),
        ("L", r"\b(?:Cofidis|Cetelem|Oney|Floabank)\b"),
    ],
    "ORG_CROIX_ROUGE": [("X", r"\bCroix[-\s]Rouge\s+française\b")],
    "ORG_EMMAUS": [("A", r"\bEmma[üu]s\b")],
    "ORG_SECOURS_POP": [("L", r"\bSecours\s+Populaire\b")],
    "ORG_SECOURS_CATHO": [("L", r"\bSecours\s+Catholique\b"), ("L", r"\bCaritas\b")],
    "ORG_FONDATION_ABBE_PIERRE": [("X", r"\bFondation\s+Abbé\s+Pierre\b")],
    "ORG_ARMEE_SALUT": [("X", r"\bArmée\s+du\s+Salut\b")],
    "ORG_APF": [("L", r"\bAPF\s+France\s+handicap\b")],
    "ORG_UNAPEI": [("L", r"\b(?:UNAPEI|ADAPEI|APEI)\b")],
    "ORG_ASEI": [*_acronyms("ASEI"), ("X", r"\bAssociation\s+au\s+Service\s+de\s+l[’']Enfance\s+Inadaptée\b")],
    "ORG_APAJH": _acronyms("APAJH"),
    "ORG_AFM_TELETHON": [("X", r"\bAFM\s+Téléthon\b")],
    "ORG_SAUVEGARDE": [("E", rf"\bSauvegarde\s+(?:\d{{2}}|de\s+l'Enfance|de\s+{LONG})\b")],
    "ORG_ASSOC_GENERIC": [
        ("I", rf"\b[Aa]ssociation\s+{NAME}(?:\s+{NAME})+\b"),
        ("I", rf"\bAsso\.?\s+{NAME}\b"),
        ("X", rf"\bSolidarité\s+(?:Femmes|Familles|Enfants|Handicap|{NAME})\b"),
        ("L", r"\bRelais\s+Insertion\s+\d{2}\b"),
        ("X", r"\bMosaïque\s+Service\s+Social\b"),
        ("L", r"\bVillage\s+d'?Enfants\s+SOS\b"),
        ("L", r"\bSOS\s+Villages?\s+d'?Enfants\b"),
        ("L", r"\bVillage\s+Enfants\s+SOS\b"),
        ("L", r"\bEnfants\s+SOS\b"),
        ("L", r"\bLa\s+Sauvegarde\b"),
    ],
    "ORG_FONDATION_GENERIC": [("I", rf"\b[Ff]ondation\s+{NAME}(?:\s+{NAME})*\b"), ("X", rf"\bŒuvre\s+(?:de\s+la\s+)?{NAME}\b")],
}
ETAB = {
    "EHPAD": _acronyms("EHPAD", "[Ee][Hh][Pp][Aa][Dd]"),
    "MAS": [*_acronyms("MAS"), ("X", r"\bMaison\s+d'Accueil\s+Spécialisée\b")],
    "FAM": [*_acronyms("FAM"), ("X", r"\bFoyer\s+d'Accueil\s+Médicalisé\b")],
    "ESAT": [*_acronyms("ESAT"), ("X", r"\bÉSAT\b"), ("X", r"\bÉtablissement\s+et\s+Service\s+d'Aide\s+par\s+le\s+Travail\b")],
    "MECS": [*_acronyms("MECS"), ("X", r"\bMaison\s+d'Enfants\s+à\s+Caractère\s+Social\b")],
    "ITEP": [("L", r"\bI?D?ITEP\b"), ("X", r"\b[Ii]nstitut\s+[Tt]h[ée]rapeutique\s+[Éé]ducatif\s+et\s+[Pp][ée]dagogique\b")],
    "IME": [*_acronyms("IME"), ("X", r"\b[Ii]nstitut\s+[Mm][ée]dico[- ]?[Éé]ducatif\b")],
    "IMPRO": [*_acronyms("IMPRO"), ("A", r"\b[Ii]nstitut\s+[Mm][ée]dico[- ]?[Pp]rofessionnel\b")],
    "IEM": [*_acronyms("IEM"), ("X", r"\b[Ii]nstitut\s+d'Éducation\s+Motrice\b")],
    "IES": [*_acronyms("IES"), ("X", r"\b[Ii]nstitut\s+d'Éducation\s+Sensorielle\b")],
    "SESSAD": [("L", r"\bSESSAD\s+TED\b"), *_acronyms("SESSAD"), ("L", r"\b[Ss]ervice\s+d'Éducation\s+Spéciale\s+et\s+de\s+Soins\s+à\s+Domicile\b")],
    "SAFEP": _acronyms("SAFEP"),
    "SSEFS": _acronyms("SSEFS"),
    "EEAP": _acronyms("EEAP"),
    "CMPP": [*_acronyms("CMPP"), ("A", r"\b[Cc]entre\s+[Mm][ée]dico[- ]?[Pp]sycho[- ]?[Pp][ée]dagogique\b")],
    "CAMSP": [*_acronyms("CAMSP"), ("A", r"\b[Cc]entre\s+d'?[Aa]ction\s+[Mm][ée]dico[- ]?[Ss]ociale\s+[Pp]r[ée]coce\b")],
    "CHRS": [*_acronyms("CHRS"), ("A", r"\b[Cc]entre\s+d'?[Hh][ée]bergement\s+et\s+de\s+[Rr][ée]insertion\s+[Ss]ociale\b")],
    "FJT": [*_acronyms("FJT"), ("L", r"\bFoyer\s+(?:de\s+)?Jeunes?\s+Travailleur[s]?\b")],
    "ETAB_RESIDENCE": [
        ("A", rf"\b[Rr][ée]sidence\s+[Mm][ée]dicalis[ée]e\s+{NAME}(?:\s+{NAME}){{0,3}}\b"),
        ("A", rf"\b[Rr][ée]sidence\s+(?:du|de\s+la|des|de\s+l')?{NAME}(?:\s+{NAME}){{0,3}}\b"),
    ],
    "ETAB_FOYER_SPECIALISE": [("I", rf"\bFoyer(?:s)?\s+de\s+vie\s+{NAME}(?:\s+{NAME}){{0,2}}\b"), ("X", rf"\bFoyer\s+d'Héberg(?:e)?ment\s+{NAME}(?:\s+{NAME}){{0,2}}\b")],
    "ETAB_SCOLAIRE": [
        ("X", rf"\b[Éé]cole\s+(?:[Éé]l[ée]mentaire\s+)?{WORD}(?:\s+{WORD}){{0,3}}\b"),
        ("A", rf"\b[Cc]oll[èe]ge\s+{WORD}(?:\s+{WORD}){{0,3}}\b"),
        ("A", rf"\b[Ll]yc[ée]e\s+(?:[Pp]rofessionnel\s+)?{WORD}(?:\s+{WORD}){{0,3}}\b"),
    ],
    "SERVICE_SAVS": _acronyms("SAVS"),
    "SERVICE_SAMSAH": _acronyms("SAMSAH"),
    "SERVICE_SSIAD": _acronyms("SSIAD"),
    "SERVICE_SPASAD": _acronyms("SPASAD"),
    "SERVICE_SAAD": [("L", r"\b(?:SAD|SAAD)\b")],
    "SERVICE_CMP": [*_acronyms("CMP"), ("A", r"\b[Cc]entre\s+[Mm][ée]dico[- ]?[Pp]sychologique\b")],
    "SERVICE_CATTP": _acronyms("CATTP"),
    "SERVICE_CSAPA": _acronyms("CSAPA"),
    "SERVICE_CAARUD": _acronyms("CAARUD"),
    "SERVICE_PASS": _acronyms("PASS"),
    "RES_AUTONOMIE": [("A", r"\b[Rr][ée]sidence(?:s)?\s+autonomie\b"), ("L", r"\b[Ff]oyer(?:-|\s)?logement\b")],
    "ACCUEIL_JOUR": [("L", r"\b[Aa]ccueil\s+de\s+jour\s+[Aa]lzheimer\b"), ("I", rf"\b[Aa]ccueil\s+de\s+jour\s+{NAME}\b")],
    "ESMS_EANM": [*_acronyms("EANM"), ("X", r"\bÉtablissement\s+d'Accueil\s+Non\s+Médicalisé\b")],
    "EA": [*_acronyms("EA"), ("X", r"\bEntreprise\s+Adaptée\b")],
    "PCPE": _acronyms("PCPE"),
    "UEMA_UEMI_UEEA": [("L", r"\b(?:UEMA|UEMI|UEEA)\b")],
    "GEM": [*_acronyms("GEM"), ("L", r"\bGroupe\s+d'Entraide\s+Mutuelle\b")],
    "CHU_CH": [*_acronyms("CHU"), ("L", r"\bCentre\s+Hospitalier(?:\s+Universitaire)?\b")],
    "EPSM": _acronyms("EPSM"),
    "PCO": [("L", r"\bPlateforme\s+de\s+Coordination\s+et\s+d'Orientation\b")],
    "HAD": [*_acronyms("HAD"), ("L", r"\bHospitalisation\s+à\s+Domicile\b")],
}
PHONE = {"PHONE": [("L", r"\b0[1-9](?:[\s\.-]?\d{2}){4}\b"), ("L", r"\+33[\s\.-]?[1-9](?:[\s\.-]?\d{2}){4}\b"), ("L", r"\b(?:1\d{2,3}|3\d{3})\b")]}
EMAIL = {"EMAIL": [("L", r"\b[\w.%+-]+@[\w.-]+\.[A-Z|a-z]{2,}\b")]}
NIR = {"NIR": [("L", r"\b[12]\s?\d{2}\s?\d{2}\s?(?:\d{2}|2[AB])\s?\d{3}\s?\d{3}\s?\d{2}\b")]}

#: Families in emission order: label, rules, whether case is ignored and whether a place may extend a match.
FAMILIES = {
    "org_regex": ("ORG", ORG, True, True),
    "etab_categories": ("ETAB", ETAB, True, True),
    "date_regex": ("DATE", {}, False, False),
    "phone_regex": ("PHONE", PHONE, False, False),
    "nir_regex": ("NIR", NIR, False, False),
    "time_regex": ("TIME", {}, False, False),
    "email_regex": ("EMAIL", EMAIL, True, False),
}


def misread(pattern: str) -> str:
    """A pattern's UTF-8 read as Windows-1252."""
    return pattern.encode().decode("cp1252")


def faithful(entry: tuple[str, ...]) -> str | None:
    """What a pattern is in the faithful profile; null if it is none."""
    status, pattern = entry[0], entry[1]
    if status == "E":
        return None
    if status == "X":
        return misread(pattern)
    if status == "P":
        return entry[2]
    if status in ("I", "A"):
        pattern = pattern.replace(CAP, "[A-Z]")
    if status == "A":
        pattern = re.sub(r"\[[éèàôü]([a-z])\]", r"\1", pattern)
    return pattern


def repaired(entry: tuple[str, ...]) -> str:
    """What a pattern is in the repaired profile: normalized texts have plain apostrophes only."""
    return entry[1].replace("[’']", "'").replace("’", "'")


_LITERAL = re.compile(r"\\b(?:\[([A-Za-z])[A-Za-z]\])?([A-Za-zÀ-ÿŒ]*)")
_CHOICE = re.compile(r"\\b\(\?:([A-Za-z|]+)\)\\b")
#: Words that matches of patterns with optional parts begin with.
ANCHORS = {
    r"\bDDETS(?:PP)?": ("ddets", "ddetspp"),
    r"\bAGIRC[-\s]?ARRCO": ("agirc", "agircarrco"),
    r"\b(?:Centre\s+Hospitalier|CHR)": ("centre", "chr"),
    r"\b[Ss]ervices?\s": ("service", "services"),
    r"\b(?:Office|Offices?)": ("office", "offices"),
    r"\bS(?:A|A\.?)\s*HLM": ("sa", "sahlm"),
    r"\bAsso\.?\s": ("asso",),
    r"\b[Ee][Hh][Pp][Aa][Dd]": ("ehpad",),
    r"\bI?D?ITEP": ("itep", "ditep", "iitep", "iditep"),
    r"\bFoyer(?:s)?\s": ("foyer", "foyers"),
    r"\b[Rr]esidence(?:s)?\s": ("residence", "residences"),
    r"\b[Rr][ée]sidence(?:s)?\s": ("résidence", "residence", "résidences", "residences"),
    r"\b[Ff]oyer(?:-|\s)?logement": ("foyer", "foyerlogement"),
    **{head: (DIGITS,) for head in (r"\b0[1-9]", r"\+33", r"\b(?:1\d{2,3}|3\d{3})", r"\b[12]\s?\d{2}\s?\d{2}")},
    r"\b[\w.%+-]+@": (AT,),
}


def anchors_of(pattern: str) -> tuple[str, ...]:
    """Lower-case words, one of which every match of the pattern begins with; none where that isn't plain."""
    for head, words in ANCHORS.items():
        if pattern.startswith(head):
            return words
    if m := _CHOICE.match(pattern):
        return tuple(m[1].lower().split("|"))
    m = _LITERAL.match(pattern)
    word = (m[1] or "") + m[2] if m else ""
    return (word.lower(),) if len(word) > 1 and pattern[m.end() :].startswith((r"\s+", r"\b")) else ()


def rules(profile: str = "faithful", extra: dict[str, dict[str, list[str]]] | None = None, shipped: bool = True) -> list[Rule]:
    """The rules of a profile in emission order, with ``extra`` patterns (family, category, patterns) after the shipped ones.

    Without ``shipped`` the extra patterns are all there are.
    """
    out: list[Rule] = []
    for family, (label, own, ignore_case, extend) in FAMILIES.items():
        categories = own if shipped else {}
        more = {c: [("L", p) for p in patterns] for c, patterns in (extra or {}).get(family, {}).items()}
        for category in [*categories, *(c for c in more if c not in categories)]:
            entries = [*((*e, profile) for e in categories.get(category, [])), *((*e, "given") for e in more.get(category, []))]
            for *entry, kind in entries:
                pattern = faithful(entry) if kind == "faithful" else repaired(entry) if kind == "repaired" else entry[1]
                if pattern is not None:
                    anchors = (MISREAD,) if kind == "faithful" and entry[0] == "X" else anchors_of(pattern)
                    out.append(Rule(len(out), family, label, category, pattern, ignore_case, extend, anchors))
    return out


def java(rule: Rule) -> str:
    """The pattern for Java's engine, with Unicode classes, boundaries and case folding."""
    return ("(?iuU)" if rule.ignore_case else "(?U)") + rule.pattern
