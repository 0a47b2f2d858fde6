"""Word lists, gazetteers and priorities that the operators share."""

from __future__ import annotations

# Characters folded by normalization, and what they become.
QUOTES_REMOVED = "«»\""
FOLDED = {
    "'": "\u02bc\u2019`\u201a",
    '"': "\u00ab\u00bb\u201c\u201d\u201e",
    "-": "\u2010\u2013\u2014\u2015",
    " ": "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a",
}

# Words that alone are no entity.
STOPWORDS = "avenue rue bd boulevard place pl secteur jean saint sainte de du des la le les nord sud est ouest centre ville".split()
FRAGMENTS = ["du", "de la", "de l", "des", "Les", "Pôle", "Industrie", "rue de l"]
AMBIGUOUS = ["ME", "C", "M", "AS", "ES", "IS"]
JOB_TITLES = [
    "technicien intervention sociale et familiale",
    "assistant familial",
    "éducateur",
    "psychologue",
    "travailleur social",
    "aide soignant",
    "conseiller",
    "référent",
    "coordinateur",
    "superviseur",
]
GENERIC_ORGS = ["conseil départemental", "département", "prefecture"]
ETAB_TOKENS = ["avenue", "rue", "boulevard", "place", "secteur", "téléphone", "phone", "email", "mail"]

# What tells establishments by their names and surroundings.
ADJACENT_TYPES = "EHPAD MAS FAM MECS IME ITEP SESSAD ESAT CMPP CAMSP FJT CHRS IMPRO IEM IES SAFEP SSEFS EEAP SAVS SAMSAH SSIAD".split()
NAME_TYPES = "SESSAD EHPAD IME MECS CHRS CMPP SAVS SAMSAH MAS FAM ITEP ESAT".split()
CONTEXT_TYPES = {
    "ETAB_MECS": ["mecs", "maison d'enfants"],
    "ETAB_IME": ["ime"],
    "ETAB_ITEP": ["itep"],
    "ETAB_SESSAD": ["sessad"],
    "ETAB_ESAT": ["esat", "établissement et service d'aide par le travail"],
    "ETAB_EHPAD": ["ehpad", "résidence médicalisée"],
    "ETAB_FOYER_VIE": ["foyer de vie"],
    "ETAB_MAS": ["mas", "maison d'accueil spécialisée"],
    "ETAB_FAM": ["fam", "foyer d'accueil médicalisé"],
}
ARTICLES = ["Les ", "Le ", "La ", "L'"]
ARTICLE_CITIES = "paris lyon marseille toulouse nice nantes montpellier strasbourg bordeaux lille rennes reims nanterre bobigny créteil montreuil".split()
HOST_VERBS = ["accueille", "accompagne", "héberge", "prend en charge", "suit", "oriente", "évalue", "propose", "offre", "dispense", "assure"]
PLANTS = "tilleuls peupliers chênes ormes platanes érables acacias cyprès pins sapins bouleaux frênes roses lilas jasmin glycines magnolias".split()
CHU_STOP = ["de", "du", "des", "le", "la", "les", "et", "ou", "avec", "pour"]
# Forms of a person's full name, and what stands around one ({} is the name).
PERSON_FORMS = [
    r"^[A-ZÀ-ÿ][a-zà-ÿ]+\s+[A-ZÀ-ÿ]{2,}$",
    r"^[A-ZÀ-ÿ][a-zà-ÿ]+\s+[A-ZÀ-ÿ][a-zà-ÿ]+$",
    r"^[A-ZÀ-ÿ]\.\s*[A-ZÀ-ÿ][a-zà-ÿ]+$",
    r"^[A-ZÀ-ÿ][a-zà-ÿ]+\s+[A-ZÀ-ÿ][a-zà-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zà-ÿ]+)?$",
]
PERSON_CONTEXT = ["mme {}", "m. {}", "monsieur {}", "madame {}", "dr {}", "professeur {}"]
PERSON_CONTEXT += ["{}, directeur", "{}, directrice", "{}, responsable", "{}, chef", "{}, tutrice", "{}, tuteur"]
PERSON_CONTEXT += [", ans", " ans,", "{}, 2", "{}, 3", "{}, 4", "{}, 5", "{}, 6"]
TITLES = ["dr ", "docteur ", "professeur ", "pr "]
CITIES = (
    "paris,marseille,lyon,toulouse,nice,nantes,montpellier,strasbourg,bordeaux,lille,rennes,reims,le havre,saint-étienne,toulon,grenoble,dijon,"
    "angers,nîmes,villeurbanne,saint-denis,le mans,aix-en-provence,clermont-ferrand,brest,limoges,tours,amiens,perpignan,metz,besançon,"
    "boulogne-billancourt,orléans,mulhouse,rouen,caen,nancy,saint-paul,argenteuil,montreuil,roubaix,tourcoing,nanterre,avignon,créteil,"
    "dunkerque,poitiers,asnières-sur-seine,versailles,courbevoie,vitry-sur-seine,colombes,pau,aulnay-sous-bois,rueil-malmaison,saint-pierre,"
    "antibes,saint-maur-des-fossés,cannes,boulogne-sur-mer,nouméa,calais,drancy,cergy,saint-nazaire,colmar,issy-les-moulineaux,"
    "noisy-le-grand,évry,villeneuve-d'ascq,la rochelle,antony,troyes,pessac,ivry-sur-seine,clichy,chambéry,lorient,montauban,niort,sète,"
    "vincennes,saint-ouen,la seyne-sur-mer,villejuif,saint-andré,clichy-sous-bois,épinay-sur-seine,meaux,merignac,valence,saint-priest,"
    "noisy-le-sec,pantin,vénissieux,caluire-et-cuire,bourges,la courneuve,cholet,sartrouville,mantes-la-jolie,bobigny"
).split(",")
ADDRESS = [r"\b(?:rue|avenue|boulevard|bd|impasse|place|pl|chemin|allée)\s+", r"\b\d{5}\b", r"\b\d{1,4}(?:bis|ter)?\s+(?:rue|avenue|boulevard|impasse)"]
CHU_NAMES = [r"\bCHU\s+(?:de\s+)?[A-ZÉ][\w'\-]+(?:\s+[A-ZÉ][\w'\-]+){0,2}\b", r"\b(?:Centre\s+Hospitalier|CHR)\s+(?:de\s+)?[A-ZÉ][\w'\-]+(?:\s+[A-ZÉ][\w'\-]+){0,2}\b"]
PERSONS = [r"\b[A-Z][a-z]+ [A-Z][A-Z]+\b", r"\bM\. [A-Z][A-Z]+\b", r"\bMme [A-Z][A-Z]+\b", r"\bDr\. [A-Z][A-Z]+\b"]
GEO = r"^\s*\b(?:à|au|aux|dans|sur|de|du|des)\s+[A-ZÉÈÀÂÎÙÔÇ][A-Za-zÀ-ÖØ-öø-ÿ'\-\s]+\b"

# Establishment types that fuse with an adjacent name, and services that are never aliased.
FUSABLE = "EHPAD MAS FAM MECS IME ITEP SESSAD ESAT CMPP CAMSP FJT CHRS IMPRO IEM IES SAFEP SSEFS EEAP SERVICE_SAVS SERVICE_SAMSAH SERVICE_SSIAD".split()
SERVICES = "SERVICE_SPASAD SERVICE_SAAD SERVICE_CMP SERVICE_CATTP SERVICE_CSAPA SERVICE_CAARUD SERVICE_PASS".split()
FUSION_GAP = 6

# Priorities by key; keys that nothing produces are left out.
PRIORITIES = {
    "RULES_EMAIL": 10.0,
    "RULES_PHONE": 9.5,
    "RULES_NIR": 9.4,
    "MERGED_TYPE_LOC_ETAB": 9.1,
    "GAZETTEER_ORG": 9.0,
    "GAZETTEER_ETAB": 9.0,
    "RULES_ORG_CHU_CH": 8.5,
    "RULES_ORG_JUSTICE": 8.4,
    "RULES_ORG_MDPH": 8.3,
    "RULES_ORG_ARS": 8.2,
    "RULES_ORG_DEPARTEMENT": 8.1,
    "RULES_ORG_PREFECTURE": 8.0,
    "RULES_EHPAD": 7.9,
    "RULES_IME": 7.8,
    "RULES_ITEP": 7.7,
    "RULES_MECS": 7.6,
    "RULES_ESAT": 7.5,
    "RULES_DATE": 4.5,
    "RULES_TIME": 4.4,
    "NER_LOC_CITY": 3.5,
    "NER_LOC": 3.0,
    "NER_PER": 2.5,
    "NER_ORG": 1.5,
}
SENSITIVE = ["EMAIL", "NIR", "PHONE", "DATE", "TIME"]
OVERLAP = 0.3
SIMILAR_LENGTH = 3

# Names known to be entities, by gazetteer, and texts that never are.
GAZETTEERS = {
    "gazetteer_bailleurs": [(n, "ORG_BAILLEUR_SOC") for n in ("OPH de l'Oise", "Habitat 33", "Habitat du Sud", "Terres & Toits 17", "Habitat 95", "Habitat 45", "Office Public de l'Habitat")],
    "gazetteer_keywords": [("CAF", "ORG_CAF"), ("CPAM", "ORG_CPAM"), ("ARS", "ORG_PUBLIC_TERR"), ("CCAS", "ORG_CCAS_CIAS"), ("CIAS", "ORG_CCAS_CIAS")],
    "gazetteer_national_org": [
        ("Pôle emploi", "ORG_PUBLIC_NAT"),
        ("URSSAF", "ORG_PUBLIC_NAT"),
        ("Caisse Nationale d'Allocations Familiales", "ORG_PUBLIC_NAT"),
        ("Croix-Rouge française", "ORG_ASSOC_NAT"),
        ("CNAM", "ORG_PUBLIC_NAT"),
        ("CNAF", "ORG_PUBLIC_NAT"),
        ("Région Auvergne-Rhône-Alpes", "ORG_PUBLIC_TERR"),
        ("Conseil Départemental", "ORG_PUBLIC_TERR"),
        ("UDAF", "ORG_ASSOC_NAT"),
        ("Union Départementale des Associations Familiales", "ORG_ASSOC_NAT"),
    ],
    "gazetteer_tech": [("MICROSOFT", "ETAB"), ("GOOGLE", "ETAB")],
}
EXCLUSIONS = [
    "banque refuse",
    "école signale",
    "Diogène",
    "habitat et d'un accompagnement",
    "habitat",
    "du",
    "de la",
    "de l",
    "Les",
    "Pôle",
    "Industrie",
    "rue de l",
    "du Clos",
    "du Lavoir",
    "du Moulin",
    "des Glycines",
    "Abord",
    "Toit d",
]
