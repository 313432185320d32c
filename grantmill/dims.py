"""Vocabularies of the grant records. Results depend on their spelling and order."""

# fixed values: categories in canonical order
CATEGORIES = ("Enterprise", "Automotive, Robotics, Industry", "Environment", "Research & Generic use", "Fintech and Marketing", "Healthcare AI", "Media & Entertainment")

# fixed values: economic sections
SECTIONS = {
    "A": "Agricoltura", "B": "Estrazione", "C": "Manifatturiero", "D": "Energia", "E": "Acqua/Rifiuti", "F": "Costruzioni", "G": "Commercio", "H": "Trasporti",
    "I": "Alloggio/Ristorazione", "J": "Informazione/Comunicazione", "K": "Finanza/Assicurazioni", "L": "Immobiliare", "M": "Attività professionali",
    "N": "Noleggio/Servizi", "O": "PA", "P": "Istruzione", "Q": "Sanità", "R": "Arte/Intrattenimento", "S": "Altri servizi", "T": "Famiglie", "U": "Organizzazioni extra-territoriali",
}

# fixed values: aid instruments
INSTRUMENTS = {1: "Sovvenzione/Contributo a fondo perduto", 2: "Prestito agevolato", 3: "Garanzia", 4: "Agevolazione fiscale", 5: "Conferimento di capitale", 6: "Anticipo rimborsabile"}

# fixed values: regions and autonomous provinces
REGIONS = (
    "Lombardia", "Lazio", "Campania", "Sicilia", "Veneto", "Emilia-Romagna", "Piemonte", "Puglia", "Toscana", "Calabria", "Sardegna", "Liguria", "Marche", "Abruzzo",
    "Friuli-Venezia Giulia", "Umbria", "Basilicata", "Molise", "Valle d'Aosta", "Trentino-Alto Adige", "Provincia Autonoma di Trento", "Provincia Autonoma di Bolzano/Bozen",
)

# fixed values: legacy label to unified label, None drops the row
UNIFIED_LABELS = {
    "Automotive & UVs": "Automotive & UVs", "Enterprise": "Enterprise", "Environment": "Environment", "Fintech and Marketing": "Fintech and Marketing",
    "Generic use": "Generic use", "Healthcare AI": "Healthcare AI", "Media & Entertainment": "Media & Entertainment", "Research": "Research",
    "Robotics and Industry": "Robotics and Industry", "Virtual assistants": "Enterprise", "Autonomous driving": "Automotive & UVs",
    "Autonomous Driving and UVs": "Automotive & UVs", "Enterprise AI": "Enterprise", "Environmental AI": "Environment", "Fintech": "Fintech and Marketing",
    "Robotics AI": "Robotics and Industry", "Data Science": None,
}

# fixed values: patterns
INDUSTRY_40 = r"\b(?:piano\s+(?:nazionale\s+)?)?(?:industria|transizione|impresa)\s*[-_.]?\s*4[\s.]*0\b"
INDUSTRY_WORDS = ("industria", "transizione", "impresa")

# fixed values: sentences around a use case; %1$s with a small first letter, %2$s as written, both without final dots, %3$s the domain
USE_CASE_TEMPLATES = (
    "AI system that performs %1$s",
    "An artificial intelligence solution designed for %1$s",
    "Technology leveraging AI and machine learning for %1$s",
    "Automated %3$s application: %1$s",
    "%2$s. This AI-powered system automates key processes in the %3$s domain",
    "A %3$s AI tool capable of %1$s",
)
