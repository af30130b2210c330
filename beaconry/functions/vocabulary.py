"""Crisis vocabulary by category and language."""

from __future__ import annotations

# fixed values: the default terms
TERMS: dict[str, dict[str, list[str]]] = {
    "violence": {
        "en": ["shooting", "shooter", "gunfire", "attack", "bombing", "stabbing", "massacre", "assault"],
        "es": ["tiroteo", "ataque", "bombardeo", "apuñalamiento", "masacre"],
        "pt": ["tiroteio", "ataque", "bombardeio", "esfaqueamento", "massacre"],
        "fr": ["fusillade", "tireur", "attaque", "attentat", "bombardement", "poignardage", "massacre", "agression"],
        "de": ["schießerei", "schütze", "schusswechsel", "anschlag", "bombenanschlag", "messerangriff", "massaker", "überfall"],
    },
    "natural_disaster": {
        "en": ["earthquake", "tsunami", "hurricane", "flood", "wildfire", "tornado"],
        "es": ["terremoto", "tsunami", "huracán", "inundación", "incendio forestal"],
        "pt": ["terremoto", "tsunami", "furacão", "enchente", "incêndio florestal"],
        "fr": ["séisme", "tremblement de terre", "tsunami", "ouragan", "inondation", "incendie de forêt", "tornade"],
        "de": ["erdbeben", "tsunami", "hurrikan", "überschwemmung", "waldbrand", "tornado"],
    },
    "platform_abuse": {
        "en": ["raid", "brigading", "bot network", "coordinated", "mass report", "doxxing"],
        "es": ["redada", "ataque coordinado", "red de bots", "reporte masivo"],
        "pt": ["ataque coordenado", "rede de bots", "denúncia em massa"],
        "fr": ["raid", "réseau de bots", "coordonné", "signalement massif", "doxing", "harcèlement coordonné"],
        "de": ["botnetz", "koordiniert", "massenmeldung", "doxing", "brigading"],
    },
    "child_safety": {
        "en": ["csam", "grooming", "minor", "underage", "exploitation"],
        "es": ["menor de edad", "explotación", "acoso a menores"],
        "pt": ["menor de idade", "exploração", "aliciamento"],
        "fr": ["mineur", "exploitation", "pédopornographie", "grooming", "harcèlement de mineurs"],
        "de": ["minderjährige", "ausbeutung", "grooming", "kindesmissbrauch", "csam"],
    },
    "self_harm": {
        "en": ["suicide", "self-harm", "cutting", "overdose", "end my life"],
        "es": ["suicidio", "autolesión", "sobredosis"],
        "pt": ["suicídio", "automutilação", "overdose"],
        "fr": ["suicide", "automutilation", "surdosage", "mettre fin à ma vie"],
        "de": ["suizid", "selbstmord", "selbstverletzung", "überdosis", "mein leben beenden"],
    },
}
# fixed values: incident type of each category
TYPE_OF = {
    "violence": "violent_extremism",
    "natural_disaster": "natural_disaster",
    "platform_abuse": "platform_manipulation",
    "child_safety": "child_safety",
    "self_harm": "self_harm",
}
LANGUAGES = ("en", "es", "pt", "fr", "de")


def terms_for(categories: list[str], language: str, custom: dict[str, list[str]]) -> list[str]:
    """Each category's list in the language, else its English one; then the custom terms of just this language."""
    out = [t for c in categories for t in TERMS.get(c, {}).get(language, TERMS.get(c, {}).get("en", []))]
    return out + custom.get(language, [])
