"""Literal inputs of queries whose operators the supplied tables don't exercise: sentences, pages, recorded answers, words and calls."""

from __future__ import annotations

FACT_SENTENCES = [
    (-1, "Planting in March suits maize in the Forest Zone."),
    (-2, "Planting window: April to June for yam near Kaduna. First rains: May."),
    (-3, "Sow cassava at 100 cm x 80 cm or 12,500 plants per hectare, with row spacing of 1 m."),
    (-4, "Apply 50 kg/ha of urea to maize. Basal dressing: 100 kg. Top dressing with 60 kg urea. The price of rice fell."),
    (-5, "N application of 90 kg ha\u22121 for sorghum; nitrogen rate of 80 kg/ha; 70 kg N per hectare; 60 kg N/ha."),
    (-6, "Urea applied at 45 kg/ha, lime applied at 30 kg, fertilised with 20 kg, a recommended rate of 25 kg ha\u207b\u00b9, given at a rate of 2 L/ha on cowpea."),
    (-7, "Weedoff Super at 20 ml/litre on tomato. Apply 3 litres/ha. Pre-harvest interval of 14 days, PHI: 7 days, phi: 9 days."),
    (-8, "A dose of 5 g/L and a concentration of 4 ml/L, applied at 2 L/ha, or at a rate of 1.5 L/ha in pepper."),
    (-9, "Maturity: 90-110 days. TMS-30572 is a released variety. Recommended for Sudan Savanna farmers of cassava"),
    (-10, "Stem borer in maize\nSymptoms: small holes in the whorl and frass on the leaves at the seedling stage.\nCultural control: destroy the stubble early\n\nChemical control: none is needed here\n\n"),
]

# a running head on every page, a table of contents by name and one by its dots
MARKED = [
    (-1, "lost\n[[PAGE:1]]\nRUNNING HEAD\nThe soil is im-\nportant.\n[[PAGE:2]]\nRUNNING HEAD\nTable of contents\nx....1\n[[PAGE:3]]\nRUNNING HEAD\n[[TABLE_START]]\n| in a table |\n[[TABLE_END]]\nDone here."),
    (-2, "[[PAGE:7]]\nOne ..... 1\nTwo ..... 2\nThree ... 3\nFour\n[[PAGE:8]]\n[[TABLE_START]]\n| in a table |\n[[TABLE_END]]\n[[PAGE:9]]\n[[TABLE_START]]\n| in a table |\n[[TABLE_END]]"),
]

PAGES = [
    ("https://farm.example/docs/index.html", '<html><body><nav><a href="/home">Home</a></nav><main><h1>Guides</h1><p>Read <a href="maize.pdf">Maize guide</a> or <a href="/rice.html"><b>Rice</b> guide</a>.</p></main><p>Related <a href="x.pdf"></a></p></body></html>'),
    ("https://reg.example/list", '<body><div class="sidebar">menu</div><div class="page-content"><table><tr><th>Product</th><th>Crop</th></tr><tr><td>Weedoff</td><td>maize</td></tr><tr><td>Alone</td></tr><tr><td>Rotstop</td><td>yam</td></tr></table></div><footer>end</footer></body>'),
    ("https://plain.example/", "<p>Only text</p><script>var a = 1;</script>"),
    ("https://null.example/", None),
]

ANSWERS = [
    ("openalex", "maize Ghana", '{"results": [{"title": "Maize spacing", "doi": "https://doi.org/10.1/ABC", "publication_year": 2019, "open_access": {"oa_url": "https://a.example/m.PDF", "oa_status": "gold"}, "abstract_inverted_index": {"maize": [1], "Sow": [0], "wide": [2]}}, {"title": "closed", "open_access": {"oa_url": null}}]}'),
    ("openalex", "broken", "not json"),
    ("semantic_scholar", "yam", '{"data": [{"title": "Yam pests", "abstract": "A pest\\nof yam.", "year": 2021, "openAccessPdf": {"url": "https://s.example/y"}, "externalIds": {"DOI": "10.2/y"}}, {"title": "no file", "openAccessPdf": null}]}'),
    ("cgspace", "rice", '{"_embedded": {"searchResult": {"_embedded": {"objects": [{"_embedded": {"indexableObject": {"name": "Rice variety trial", "handle": "1/2", "metadata": {"dc.date.issued": [{"value": "2017-05"}]}, "_embedded": {"bundles": {"_embedded": {"bundles": [{"name": "THUMBNAIL"}, {"name": "ORIGINAL", "_embedded": {"bitstreams": {"_embedded": {"bitstreams": [{"_links": {"content": {"href": "https://c.example/b/content"}}}]}}}}]}}}}}}, {"_embedded": {"indexableObject": {"name": "Rice page", "handle": "3/4", "metadata": {"dcterms.issued": [{"value": "2020"}]}}}}]}}}}'),
]
ENRICHMENT = [("10.1/abc", "https://better.example/m.pdf"), ("10.9/none", "https://x.example")]

WORDS = [
    (1, "Header", 30.0, 5.0), (1, "01-1234", 326.0, 20.0), (1, "Weed", 30.0, 20.2), (1, "off", 50.0, 20.2), (1, "Super", 30.0, 28.0), (1, "Glyphosate", 84.5, 20.0), (1, "12/03/2020", 361.0, 20.0), (1, "till", 404.0, 20.0), (1, "11/03/2025", 404.0, 29.0),
    (1, "1L/BOTTLE", 440.0, 20.0), (1, "China", 490.0, 20.0), (1, "A5-0007B", 326.0, 40.0), (1, "R o t s t", 30.0, 39.6), (1, "India", 490.0, 40.0), (1, "beyond", 600.0, 40.0), (2, "99-123456", 330.0, 10.0), (2, "Mancozeb", 90.0, 10.0), (2, "Rotstop", 30.0, 10.0),
]

CALLS = [
    ("case01", '{"function": "fertiliser_rate", "params": {"crop": " Maize ", "zone": "Northern Guinea Savanna", "area_ha": "1"}}'),
    ("case02", '```json\n{"function": "seed_rate", "params": {"crop": "maize", "area_ha": 1, "spacing_cm": [75, 25], "germination_pct": 85}}\n```'),
    ("case03", 'Sure: {"function": "spray_dilution", "params": {"product_name": "Glyphosate", "tank_litres": 15}} done'),
    ("case04", '{"function": "gross_margin", "params": {"yield_kg": 3000, "price_per_kg": 250, "input_costs": [{"label": "seed", "amount": 15000.4}, {"label": "work", "amount": 120000.2}]}}'),
    ("case05", '{"error": "I cannot do that."}'),
    ("case06", "garbage"),
    ("case07", '{"function": "fertiliser_rate", "params": {"crop": "okra", "zone": "Z", "area_ha": 2}}'),
    ("case08", '{"function": "fertiliser_rate", "params": {"crop": "maize", "area_ha": 2}}'),
    ("case09", '{"function": "fertiliser_rate", "params": {"crop": "maize", "zone": "Nowhere", "area_ha": 2}}'),
    ("case10", '{"function": "seed_rate", "params": {"crop": "maize", "area_ha": 0, "spacing_cm": [75, 25], "germination_pct": 85}}'),
    ("case11", '{"function": "seed_rate", "params": {"crop": "maize", "area_ha": 1, "spacing_cm": 75, "germination_pct": 85}}'),
    ("case12", '{"function": "seed_rate", "params": {"crop": "maize", "area_ha": 1, "spacing_cm": [75, "x"], "germination_pct": 85}}'),
    ("case13", '{"function": "seed_rate", "params": {"crop": "maize", "area_ha": 1, "spacing_cm": [75, 0], "germination_pct": 85}}'),
    ("case14", '{"function": "seed_rate", "params": {"crop": "maize", "area_ha": 1, "spacing_cm": [75, 25], "germination_pct": 101}}'),
    ("case15", '{"function": "spray_dilution", "params": {"product_name": "X", "tank_litres": "no"}}'),
    ("case16", '{"function": "spray_dilution", "params": {"product_name": "Nothing", "tank_litres": 15}}'),
    ("case17", '{"function": "gross_margin", "params": {"yield_kg": -1, "price_per_kg": 250, "input_costs": []}}'),
    ("case18", '{"function": "gross_margin", "params": {"yield_kg": 1, "price_per_kg": 250, "input_costs": [{"label": "a", "amount": -2}]}}'),
    ("case19", '{"function": "gross_margin", "params": {"yield_kg": 1, "price_per_kg": 250, "input_costs": [{"label": "a"}]}}'),
    ("case20", '{"function": "weather", "params": {}}'),
]

LOG = [
    (1, "[2024-01-01] source=OpenAlex url=https://api.example/s?q=maize%20spacing%20Ghana status=blocked:403 headers={}"),
    (2, "[2024-01-02] source=Open Alex url=https://api.example/s?q=yam status=http_error:500 headers={}"),
    (3, "[2024-01-03] source=OpenAlex url=https://api.example/s?q=maize%20spacing%20Ghana status=robots_disallowed headers={}"),
    (4, "no entry"),
]
CRAWLED = [("openalex+unpaywall", "Ghana", "maize;yam"), ("cgspace", "Mali", "rice"), ("naerls_direct", "", ""), ("openalex", "", "rice"), ("other", "Mali", "rice")]
GRID, SINGLE, DIRECT = {"openalex": "openalex", "openalex+unpaywall": "openalex"}, {"cgspace": "cgspace"}, {"naerls_direct": ("naerls", ["/publications", "/"])}

TITLES = [
    (1, "Guide to maize spacing in Kano", "maize"), (2, "Guide to maize spacing in Kano.", "maize;yam"), (3, "Guide to maize spacing at Kano", "rice"), (4, "", "maize"), (5, " ", "maize"), (6, "Another thing", None), (7, "another thing!", ""),
    (8, "Guide to  maize spacings in Kano", "yam"), (9, None, "yam"),
]

# The questions that measure retrieval: crop, symptom and topic; crops asked about in two wordings; crops; crop, question and place.
SYMPTOMS = [
    ("maize", "extensive tunnelling and holes bored into the stem, with visible frass", "pest_management"),
    ("maize", "narrow yellow-to-white streaks running parallel along the leaves", "disease_management"),
    ("cassava", "white, waxy, powdery insects clustered on the undersides of leaves and stunted shoot growth", "pest_management"),
    ("cassava", "mottled yellow-and-green mosaic patterns and distorted, misshapen leaves", "disease_management"),
    ("rice", "leaves folded and webbed together with white streaks running along the fold", "pest_management"),
    ("rice", "diamond-shaped grey lesions with brown borders on the leaves", "disease_management"),
    ("cowpea", "holes bored into the flower buds and developing pods", "pest_management"),
    ("cowpea", "mottled yellow mosaic patterns on young leaves and stunted growth", "disease_management"),
    ("yam", "tunnels bored into the tuber surface and internal galleries", "pest_management"),
    ("yam", "dark, sunken leaf spots that expand and cause premature defoliation", "disease_management"),
    ("tomato", "tiny insects clustered under the leaves with a sticky honeydew residue and sooty mould", "pest_management"),
    ("tomato", "sudden wilting of the whole plant despite adequate soil moisture", "disease_management"),
    ("sorghum", "stunted, yellowing plants with a parasitic weed attached to the roots", "pest_management"),
    ("sorghum", "reddish-brown lesions on the leaves and lodging of the stem", "disease_management"),
    ("groundnut", "holes bored into the pods and shrivelled, damaged kernels", "pest_management"),
    ("groundnut", "severe stunting, yellow mottling, and bunched leaves", "disease_management"),
    ("pepper", "curling, yellowing leaves and clusters of tiny insects on the underside", "pest_management"),
    ("pepper", "dark, sunken lesions on the ripening fruit", "disease_management"),
    ("soybean", "extensive leaf defoliation and damaged pods from chewing insects", "pest_management"),
    ("soybean", "small rust-coloured pustules on the underside of the leaves", "disease_management"),
]
RATE_CROPS = {"in Nigeria": ["maize", "cassava", "rice", "cowpea", "yam", "tomato", "sorghum", "groundnut", "pepper", "soybean"], "production in Africa": ["maize", "cassava", "rice", "cowpea", "groundnut"]}
STORED_CROPS = ["maize", "cassava", "rice", "cowpea", "yam", "tomato", "sorghum", "groundnut", "pepper", "soybean"]
VARIETIES = [
    ("maize", "What IITA-released maize varieties are recommended for Nigeria?", "Nigeria"),
    ("cassava", "Which cassava cultivars have been released by IITA for West Africa?", "West Africa"),
    ("cowpea", "What are the characteristics of improved cowpea genotypes for Nigerian farmers?", "Nigeria"),
    ("soybean", "Which soybean varieties are recommended for the Guinea Savanna zone?", "Guinea Savanna"),
    ("yam", "What improved yam varieties have been released for smallholder production in Nigeria?", "Nigeria"),
]


def gold_questions() -> list[tuple[str, str, str, str, str, str]]:
    """(id, query, crop, zone, tier, expected_topic), numbered in the order of the four kinds."""
    rows = [(f"A farmer's {c} crop shows {s} -- what pest or disease is this and how should it be controlled?", c, "", "pest_disease_diagnosis", t) for c, s, t in SYMPTOMS]
    rows += [(f"What nitrogen rate is recommended for {c} {where}?", c, where.split()[-1], "fertiliser_rate", "fertilisation") for where, crops in RATE_CROPS.items() for c in crops]
    rows += [(f"What are the main post-harvest storage challenges for {c}?", c, "", "crop_management_storage", "storage") for c in STORED_CROPS]
    rows += [(q, c, z, "variety_selection", "variety_selection") for c, q, z in VARIETIES]
    return [(f"Q{i:03d}", *r) for i, r in enumerate(rows, 1)]
