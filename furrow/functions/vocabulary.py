"""Default vocabularies. Every operator that uses one takes it as an argument."""

from __future__ import annotations

# Crops, zones, countries and words that mark the kind of a table or topic, in the order in which they win.
CROPS = ["maize", "cassava", "rice", "cowpea", "yam", "tomato", "sorghum", "groundnut", "pepper", "soybean"]
ZONES = ["Sudan Savanna", "Northern Guinea Savanna", "Southern Guinea Savanna", "Derived Savanna", "Forest Zone", "Mangrove/Coastal"]
COUNTRIES = ["Nigeria", "Kenya", "Ghana", "Tanzania", "Uganda", "Ethiopia", "Rwanda", "Senegal", "Mali", "Burkina Faso"]
TABLE_WORDS = {
    "crop_calendar": ["planting date", "planting window", "first rains", "sowing date", "cropping calendar"],
    "spacing": ["spacing", "plants per hectare", "row spacing", "plant population"],
    "fertilizer_rate": ["fertiliser", "fertilizer", "npk", "basal dressing", "top dress", "urea"],
    "agrochemical": ["pesticide", "insecticide", "fungicide", "herbicide", "agrochemical", "pre-harvest interval"],
    "variety": ["variety", "cultivar", "released variety", "maturity days"],
    "pest": ["pest", "symptom", "disease", "cultural control", "chemical control", "infestation"],
}
TOPIC_WORDS = {
    "planting": ["planting", "sowing", "seed rate", "planting date", "transplanting", "nursery", "seedbed"],
    "fertilisation": ["fertiliser", "fertilizer", "npk", "urea", "manure", "basal dressing", "top dress", "nutrient"],
    "pest_management": ["pest", "insect", "infestation", "insecticide", "weevil", "borer", "aphid"],
    "disease_management": ["disease", "fungus", "fungicide", "blight", "wilt", "rot", "virus", "pathogen"],
    "harvest": ["harvest", "harvesting", "maturity", "threshing", "reaping"],
    "storage": ["storage", "storing", "warehouse", "silo", "post-harvest loss", "drying"],
    "variety_selection": ["variety", "cultivar", "released variety", "hybrid", "seed selection"],
    "soil_management": ["soil", "tillage", "ploughing", "erosion", "soil fertility", "organic matter"],
    "irrigation": ["irrigation", "watering", "drought", "water management", "rainfall"],
    "market": ["market", "price", "sale", "marketing", "value chain", "profit", "income"],
}
PUBLISHER_POINTS = {
    "NAERLS": 30, "NAERLS (via Google Scholar)": 30, "FMARD": 30, "ADP": 30, "IITA": 25, "CGIAR": 25, "CIMMYT": 25, "ICRISAT": 25, "AfricaRice": 25,
    "FAO": 20, "CABI PlantWise": 20, "ResearchGate": 10, "academia.edu (NAERLS fallback)": 10, "NIHORT": 30, "NCRI": 30, "CRIN": 30, "NAFDAC": 25,
}
LOOSE_ZONES = ["savanna", "forest zone", "mangrove", "coastal"]
LEXICON = {
    "masara": "maize", "gero": "pearl millet", "dawa": "sorghum", "shinkafa": "rice", "rogo": "cassava", "gudaji": "cowpea", "wake": "cowpea",
    "gyada": "groundnut", "yakuwa": "sorrel", "kwari": "insect pest", "cuta": "disease", "takin zamani": "inorganic fertiliser", "taki": "fertiliser",
    "maganin kwari": "pesticide", "feshin magani": "spray dilution",
    "oka": "maize", "agbado": "maize", "ewa": "cowpea", "iwi": "cowpea", "gbaguda": "cassava", "iṣu": "yam", "isu": "yam", "iresi": "rice", "baba": "sorghum",
    "epà": "groundnut", "epa": "groundnut", "kókó": "cocoa", "koko": "cocoa", "kokoro": "insect pest", "arun": "disease", "ile-ira": "fertiliser", "ogbin": "crop",
    "corn": "maize", "beans": "cowpea", "cassava": "cassava", "yam": "yam", "rice": "rice", "groundnut": "groundnut", "tomati": "tomato", "pepper": "pepper",
    "agric": "agricultural", "chemical": "agrochemical", "pesticide": "agrochemical", "fertilizer": "fertiliser", "medicine": "pesticide", "bug": "pest",
    "akpu": "cassava", "ji": "yam", "osikapa": "rice", "anara": "garden egg", "egusi": "melon", "ogwu": "pesticide", "nri ala": "fertiliser",
}
LANGUAGE_MARKS = {
    "ha": ["masara", "gero", "dawa", "shinkafa", "rogo", "wake", "gyada", "kwari", "cuta", "taki", "magani"],
    "yo": ["agbado", "ewa", "gbaguda", "isu", "iresi", "baba", "epa", "kokoro", "arun", "ogbin"],
    "pcm": ["dey", "wey", "fit", "make", "watin", "wetin", "una", "am", "so", "pata", "finish"],
    "ig": ["akpu", "osikapa", "ogwu", "kwanu", "di", "mya"],
}
