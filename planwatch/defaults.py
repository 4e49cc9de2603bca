"""Default vocabularies. Every operator takes them as arguments; these are only what a call gets that names none.

Fixed values: the word lists, patterns, states and limits below are the domain's own.
"""

COMMITTEE_PATTERNS = ("stadtentwicklung", "stadtplanung", "planung", "wohnungsbau", r"\bbau(en|ausschuss|angelegenheiten)?\b", "bauausschuss")
PERMIT_WORDS = ("Baugenehmigung", "Baufreigabe", "Bauantrag genehmigt", "Bauantrag ist genehmigt", "Genehmigung erteilt", "Genehmigung liegt vor")
START_WORDS = ("Baubeginn", "Baustart", "Spatenstich", "Grundsteinlegung", "Grundstein gelegt", "Richtfest", "Bauarbeiten begonnen", "Bauarbeiten haben begonnen")
FUTURE_WORDS = ("geplant", "soll ", "sollen", "voraussichtlich", "vorgesehen", "erwartet", "wird ", "werden ", "ab 20", "im kommenden", "nächste")
HOUSING_WORDS = ("Wohnung", "Wohneinheit", "Mehrfamilienhaus", "Mehrfamilienhäuser", "Wohnungsbau", "Wohnquartier", "Wohnanlage", "Wohnprojekt", "Sozialwohnung", "geförderte")
OWNERSHIP_WORDS = ("Eigentumswohnung", "ETW")
RENT_WORDS = ("Miet", "gefördert", "Sozialwohnung", "Drittelmix", "Belegungsbindung", "Wohnberechtigungsschein")
EXCLUDED_DOMAINS = ("immobilienscout24.de", "immowelt.de", "immonet.de", "kleinanzeigen.de", "wohnungsboerse.net")
UNIT_PATTERN = (
    r"(?iu)(?<![\d.,])(\d{1,2}\.\d{3}|\d{1,4})\s+"
    r"(?:(?:neue[nr]?|weitere[nr]?|moderne[nr]?|öffentlich|frei|finanzierte[nr]?|geförderte[nr]?|barrierefreie[nr]?|bezahlbare[nr]?)\s+)*"
    r"(?:Miet|Sozial|Eigentums)?(?:wohnungen|wohneinheiten)(?U:\b)"
)
PLAN_PATTERN = r"(?:bebauungsplan(?:es)?|b-plan|bplan)\s*(?:nr\s*\.?\s*)?"
TENURES = ("MIETE", "GEFOERDERT", "EIGENTUM", "GEMISCHT", "SONDERWOHNFORM", "UNKLAR")
STAGES = ("VORBERATUNG", "AUFSTELLUNGSBESCHLUSS", "AUSLEGUNG", "SATZUNGSBESCHLUSS", "BAUANTRAG", "BAUGENEHMIGUNG", "UNKLAR")
PHASE_RANK = {"BAUGENEHMIGUNG": 3, "BAUBEGINN": 4}
UNSETTLED = ("neu", "FEHLER", "BUDGET_ERSCHOEPFT")
HINT_STAGES = ("UNKLAR", "VORBERATUNG")
HINT_WORDS = ("baugenehmigung", "bauantr", "bauvoranfrage", "vorbescheid", "einvernehmen")
BADGE_PERMIT, BADGE_APPLICATION, BADGE_HINT, BADGE_REVIEW = "🟢 Baugenehmigung", "🔵 Bauantrag", "🔎 Hinweis im Text", "⚠ prüfen"
ARCHIVED = "Archiviert"
#: Texts of review tasks; {0}: what is known of the tenure or the confidence, {1} and {2}: limits of homes to rent and for sale.
REVIEW_TENURE = "Wohnform unklar: {0} Prüfen: beim Bauträger oder in den Anlagen klären - relevant ab {1} Miet-/geförderten WE bzw. {2} Eigentums-WE."
REVIEW_SHARE = ("Geförderter Anteil bekannt (ca. ", "%), für den Rest nennt die Quelle nicht, ob Miete oder Eigentum.")
REVIEW_NO_SHARE = "Die Quelle sagt nicht, ob Miete, gefördert oder Eigentum."
REVIEW_UNITS = "Keine Zahl der Wohneinheiten gefunden. Prüfen: Anzahl in den Anlagen (Begründung, städtebaulicher Vertrag) oder beim Bauträger nachsehen."
REVIEW_UNSURE = ("Die KI war sich unsicher (Konfidenz ", "%). Prüfen: WE-Zahl, Adresse und Verfahrensstand mit der Originalquelle abgleichen.")
#: Reasons why a search result is no find; {0}: a host, a place, a number of homes, and {1}: the least of them.
REJECT_DOMAIN, REJECT_PLACE, REJECT_HOUSING = "Website ausgeschlossen ({0})", "Ort {0} nicht genannt", "kein Wohnbau"
REJECT_PHASE = "keine Baugenehmigung und kein Baubeginn im Text (Frühphase)"
REJECT_OWNERSHIP = "reines Eigentumsprojekt mit {0} WE (unter {1})"
REJECT_NO_PLACE = "kein Ort im Umkreis genannt"
RENT_LEAST_UNITS = 6
ORIGINS = ("radar", "manuell")
OWNERSHIP_LEAST_UNITS, REVIEW_CONFIDENCE = 12, 0.6
UNITS_RANGE = (2, 5000)
BEFORE, AFTER, QUOTE_AROUND, QUOTE_MOST = 25, 45, 80, 200
EXCERPT_CHARS, CONTEXT_PAGES = 60_000, 1
TITLE_MOST, EXCERPT_MOST, PRESS_EXCERPT_MOST = 300, 600, 300
EARTH_RADIUS_KM = 6371.0
ZONE = "Europe/Berlin"
