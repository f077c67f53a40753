"""Expected rows of the queries over ``cases``, read off the inputs by hand: column names, then one row per line."""

from __future__ import annotations

EXPECTED: dict[str, tuple[list[str], list[tuple]]] = {
    "html_to_text": (["url", "text"], [
        ('https://farm.example/docs/index.html', '[[PAGE:1]]\nGuides\nRead\nMaize guide\nor\nRice\nguide\n.'),
        ('https://reg.example/list', '[[PAGE:1]]\nProduct\nCrop\nWeedoff\nmaize\nAlone\nRotstop\nyam'),
        ('https://plain.example/', '[[PAGE:1]]\nOnly text'),
        ('https://null.example/', None),
    ]),
    "page_links": (["url", "link_no", "link", "link_title", "link_format"], [
        ('https://farm.example/docs/index.html', 0, 'https://farm.example/docs/maize.pdf', 'Maize guide', 'PDF'),
        ('https://farm.example/docs/index.html', 1, 'https://farm.example/rice.html', 'Rice guide', 'HTML'),
        ('https://farm.example/docs/index.html', 2, 'https://farm.example/docs/x.pdf', 'untitled', 'PDF'),
    ]),
    "html_tables": (["url", "table_no", "row_no", "cells", "crop"], [
        ('https://reg.example/list', 0, 0, 'Weedoff|maize', 'maize'),
        ('https://reg.example/list', 0, 1, 'Rotstop|yam', 'yam'),
    ]),
    "api_rows": (["query", "hit", "publisher", "year", "format", "licence", "doi", "url", "title", "crops_covered", "zones_mentioned", "sql_tables_likely", "abstract_snippet", "api_source"], [
        ('maize Ghana', 0, 'OpenAlex', '2019', 'PDF', 'gold', '10.1/abc', 'https://better.example/m.pdf', 'Maize spacing', 'maize', '', 'spacing', 'Sow maize wide', 'openalex+unpaywall'),
        ('yam', 0, 'Semantic Scholar', '2021', 'PDF', 'open access (Semantic Scholar verified)', '10.2/y', 'https://s.example/y', 'Yam pests', 'yam', '', 'pest', 'A pest of yam.', 'semantic_scholar'),
        ('rice', 1, 'CGSpace', '2020', 'HTML', 'CGIAR open access (CGSpace)', '', 'https://c.example/handle/3/4', 'Rice page', 'rice', '', '', '', 'cgspace'),
        ('rice', 0, 'CGSpace', '2017', 'PDF', 'CGIAR open access (CGSpace)', '', 'https://c.example/b/content', 'Rice variety trial', 'rice', '', 'variety', '', 'cgspace'),
    ]),
    "register_rows": (["page", "row_no", "product_name", "active_ingredient", "reg_no", "date_registered", "reg_expiry", "presentation", "country", "confidence", "needs_review"], [
        (1, 1, 'Weed off Super', 'Glyphosate', '01-1234', '12/03/2020', '11/03/2025', '1L/BOTTLE', 'China', 1.0, False),
        (1, 2, 'R o t s t', '', 'A5-0007B', '', '', '', 'India', 0.4, True),
        (2, 1, 'Rotstop', 'Mancozeb', '99-123456', '', '', '', '', 1.0, False),
    ]),
    "checkpoint_rebuild": (["key", "outcome"], [
        ('Open Alex:https://api.example/s?q=yam', 'http_500'),
        ('OpenAlex:https://api.example/s?q=maize%20spacing%20Ghana', 'blocked_robots'),
        ('cgspace:rice Mali', 'success'),
        ('naerls:/', 'success'),
        ('naerls:/publications', 'success'),
        ('openalex:maize Ghana smallholder farming', 'success'),
        ('openalex:maize agro-ecological zone Ghana recommendation', 'success'),
        ('openalex:maize production guide Ghana extension', 'success'),
        ('openalex:yam Ghana smallholder farming', 'success'),
        ('openalex:yam agro-ecological zone Ghana recommendation', 'success'),
        ('openalex:yam production guide Ghana extension', 'success'),
    ]),
    "title_pair_cases": (["earlier", "later", "ratio"], [
        (1, 2, 0.983607),
        (2, 8, 0.952381),
        (4, 5, 1.0),
        (6, 7, 0.962963),
    ]),
    "extract_crop_calendar": (["doc_id", "pattern", "start", "crop", "zone", "state", "activity", "month_start", "month_end", "raw_text", "confidence"], [
        (-1, 'plant_in_month', 0, 'maize', 'Forest Zone', '', 'plant_in_month', 'March', '', 'Planting in March suits maize in the Forest Zone.', 1.0),
        (-2, 'planting_window', 0, 'yam', '', 'kaduna', 'planting_window', 'April', 'June', 'Planting window: April to June for yam near Kaduna. First rains: May.', 1.0),
        (-2, 'first_rains', 52, 'yam', '', 'kaduna', 'first_rains', 'May', '', 'Planting window: April to June for yam near Kaduna. First rains: May.', 1.0),
    ]),
    "extract_spacing": (["doc_id", "pattern", "start", "crop", "spacing_cm", "plants_per_ha", "row_spacing_cm", "raw_text", "confidence"], [
        (-3, 'spacing_cm_x_cm', 15, 'cassava', '100x80', '', '', 'Sow cassava at 100 cm x 80 cm or 12,500 plants per hectare, with row spacing of 1 m.', 0.85),
        (-3, 'plants_per_ha', 33, 'cassava', '', '12500', '', 'Sow cassava at 100 cm x 80 cm or 12,500 plants per hectare, with row spacing of 1 m.', 0.85),
        (-3, 'row_spacing', 65, 'cassava', '', '', '1', 'assava at 100 cm x 80 cm or 12,500 plants per hectare, with row spacing of 1 m.', 0.85),
    ]),
    "extract_fertilizer_rate": (["doc_id", "pattern", "start", "crop", "fertilizer_type", "rate_kg_ha", "application_stage", "raw_text", "confidence"], [
        (-4, 'apply_kg_ha', 0, 'maize', 'urea to maize', '50', 'apply_kg_ha', 'Apply 50 kg/ha of urea to maize. Basal dressing: 100 kg. Top dressing with 60 kg urea. The', 1.0),
        (-4, 'bare_kg_ha', 6, 'maize', '', '50', 'bare_kg_ha', 'Apply 50 kg/ha of urea to maize. Basal dressing: 100 kg. Top dressing with', 0.65),
        (-4, 'basal_dressing', 33, 'maize', 'urea', '100', 'basal_dressing', 'Apply 50 kg/ha of urea to maize. Basal dressing: 100 kg. Top dressing with 60 kg urea. The price of rice fell.', 1.0),
        (-4, 'top_dress', 57, 'maize', 'urea', '60', 'top_dress', 'Apply 50 kg/ha of urea to maize. Basal dressing: 100 kg. Top dressing with 60 kg urea. The price of rice fell.', 1.0),
        (-5, 'n_application', 0, 'sorghum', 'nitrogen', '90', 'n_application', 'N application of 90 kg ha−1 for sorghum; nitrogen rate of 80 kg/ha; 70 kg N per hectare', 1.0),
        (-5, 'bare_kg_ha', 17, 'sorghum', '', '90', 'bare_kg_ha', 'N application of 90 kg ha−1 for sorghum; nitrogen rate of 80 kg/ha; 70 kg N per hectare', 0.65),
        (-5, 'nitrogen_rate', 41, 'sorghum', 'nitrogen', '80', 'nitrogen_rate', 'N application of 90 kg ha−1 for sorghum; nitrogen rate of 80 kg/ha; 70 kg N per hectare; 60 kg N/ha.', 1.0),
        (-5, 'bare_kg_ha', 58, 'sorghum', '', '80', 'bare_kg_ha', 'N application of 90 kg ha−1 for sorghum; nitrogen rate of 80 kg/ha; 70 kg N per hectare; 60 kg N/ha.', 0.65),
        (-5, 'kg_n_per_ha', 68, 'sorghum', 'nitrogen', '70', 'kg_n_per_ha', 'ation of 90 kg ha−1 for sorghum; nitrogen rate of 80 kg/ha; 70 kg N per hectare; 60 kg N/ha.', 1.0),
        (-5, 'kg_n_slash_ha', 89, 'sorghum', 'nitrogen', '60', 'kg_n_slash_ha', 'or sorghum; nitrogen rate of 80 kg/ha; 70 kg N per hectare; 60 kg N/ha.', 1.0),
        (-6, 'applied_at_kg_ha', 5, 'cowpea', '', '45', 'applied_at_kg_ha', 'Urea applied at 45 kg/ha, lime applied at 30 kg, fertilised with 20 kg, a recommende', 0.85),
        (-6, 'applied_at_kg', 5, 'cowpea', '', '45', 'applied_at_kg', 'Urea applied at 45 kg/ha, lime applied at 30 kg, fertilised with 20 kg, a recomme', 0.85),
        (-6, 'bare_kg_ha', 16, 'cowpea', '', '45', 'bare_kg_ha', 'Urea applied at 45 kg/ha, lime applied at 30 kg, fertilised with 20 kg, a recommende', 0.65),
        (-6, 'applied_at_kg', 31, 'cowpea', '', '30', 'applied_at_kg', 'Urea applied at 45 kg/ha, lime applied at 30 kg, fertilised with 20 kg, a recommended rate of 25 kg ha⁻¹, g', 0.85),
        (-6, 'fertilized_with', 49, 'cowpea', '', '20', 'fertilized_with', 'Urea applied at 45 kg/ha, lime applied at 30 kg, fertilised with 20 kg, a recommended rate of 25 kg ha⁻¹, given at a rate of 2 L/h', 0.85),
        (-6, 'recommended_rate', 74, 'cowpea', '', '25', 'recommended_rate', 't 45 kg/ha, lime applied at 30 kg, fertilised with 20 kg, a recommended rate of 25 kg ha⁻¹, given at a rate of 2 L/ha on cowpea.', 0.85),
        (-6, 'bare_kg_ha', 94, 'cowpea', '', '25', 'bare_kg_ha', 'lied at 30 kg, fertilised with 20 kg, a recommended rate of 25 kg ha⁻¹, given at a rate of 2 L/ha on cowpea.', 0.65),
        (-6, 'at_a_rate_of', 112, 'cowpea', '', '2', 'at_a_rate_of', 'tilised with 20 kg, a recommended rate of 25 kg ha⁻¹, given at a rate of 2 L/ha on cowpea.', 0.85),
        (-8, 'at_a_rate_of', 69, 'pepper', '', '1.5', 'at_a_rate_of', '5 g/L and a concentration of 4 ml/L, applied at 2 L/ha, or at a rate of 1.5 L/ha in pepper.', 0.85),
    ]),
    "extract_agrochemical": (["doc_id", "pattern", "start", "crop", "product_name", "active_ingredient", "rate", "rate_unit", "pre_harvest_interval_days", "raw_text", "confidence"], [
        (-6, 'rate_of_l_ha', 112, 'cowpea', '', '', '2', 'L/ha', '', 'tilised with 20 kg, a recommended rate of 25 kg ha⁻¹, given at a rate of 2 L/ha on cowpea.', 0.75),
        (-7, 'product_rate', 0, 'tomato', 'Weedoff Super', '', '20', 'ml/litre', '', 'Weedoff Super at 20 ml/litre on tomato. Apply 3 litres/ha. Pre-harvest interval of 14 da', 0.85),
        (-7, 'litres_ha', 40, 'tomato', '', '', '3', 'litres/ha', '', 'Weedoff Super at 20 ml/litre on tomato. Apply 3 litres/ha. Pre-harvest interval of 14 days, PHI: 7 days, phi: 9 days.', 0.75),
        (-7, 'interval', 59, 'tomato', '', '', '', '', '14', 'Weedoff Super at 20 ml/litre on tomato. Apply 3 litres/ha. Pre-harvest interval of 14 days, PHI: 7 days, phi: 9 days.', 0.85),
        (-7, 'interval_short', 92, 'tomato', '', '', '', '', '7', 'tomato. Apply 3 litres/ha. Pre-harvest interval of 14 days, PHI: 7 days, phi: 9 days.', 0.85),
        (-8, 'dose', 2, 'pepper', '', '', '5', 'g/L', '', 'A dose of 5 g/L and a concentration of 4 ml/L, applied at 2 L/ha, or at a r', 0.75),
        (-8, 'concentration', 22, 'pepper', '', '', '4', 'ml/L', '', 'A dose of 5 g/L and a concentration of 4 ml/L, applied at 2 L/ha, or at a rate of 1.5 L/ha in pepper.', 0.75),
        (-8, 'applied_at_l_ha', 47, 'pepper', '', '', '2', 'L/ha', '', 'A dose of 5 g/L and a concentration of 4 ml/L, applied at 2 L/ha, or at a rate of 1.5 L/ha in pepper.', 0.75),
        (-8, 'rate_of_l_ha', 69, 'pepper', '', '', '1.5', 'L/ha', '', '5 g/L and a concentration of 4 ml/L, applied at 2 L/ha, or at a rate of 1.5 L/ha in pepper.', 0.75),
    ]),
    "extract_variety": (["doc_id", "pattern", "start", "crop", "variety_name", "maturity_days", "zone", "raw_text", "confidence"], [
        (-9, 'maturity', 0, 'cassava', '', '90-110', 'Sudan Savanna', 'Maturity: 90-110 days. TMS-30572 is a released variety. Recommended for Sudan Sav', 1.0),
        (-9, 'released', 23, 'cassava', 'TMS-30572', '', 'Sudan Savanna', 'Maturity: 90-110 days. TMS-30572 is a released variety. Recommended for Sudan Savanna farmers of cassava', 1.0),
        (-9, 'recommended', 56, 'cassava', '', '', 'Sudan Savanna', 'Maturity: 90-110 days. TMS-30572 is a released variety. Recommended for Sudan Savanna farmers of cassava', 0.8),
    ]),
    "extract_pest": (["doc_id", "pattern", "start", "crop", "pest_name", "symptoms", "growth_stage", "cultural_control", "chemical_control", "raw_text", "confidence"], [
        (-10, 'pest_name', 0, 'maize', 'Stem borer', 'small holes in the whorl and frass on the leaves at the seedling stage. Cultural control: destroy the stubble early', 'seedling', 'destroy the stubble early', 'none is needed here', 'Stem borer in maize Symptoms: small holes in the whorl and frass on the leaves at the seedling stage. Cultural control: destroy the stubble early  Chemical control: none is needed here  ', 1.0),
    ]),
    "tool_validation": (["id", "function", "error_message"], [
        ('case01', 'fertiliser_rate', None),
        ('case02', 'seed_rate', None),
        ('case03', 'spray_dilution', None),
        ('case04', 'gross_margin', None),
        ('case05', None, 'I cannot do that.'),
        ('case06', None, None),
        ('case07', 'fertiliser_rate', "The crop 'okra' is not supported. Supported crops are: cassava, cowpea, maize, rice, tomato, yam."),
        ('case08', 'fertiliser_rate', 'I need the crop, area in hectares, and the agro-ecological zone to calculate the fertilizer rate.'),
        ('case09', 'fertiliser_rate', None),
        ('case10', 'seed_rate', 'Area must be greater than zero.'),
        ('case11', 'seed_rate', 'Spacing must be a list of two positive numbers (e.g. [75, 25]).'),
        ('case12', 'seed_rate', 'Spacing must contain valid numbers.'),
        ('case13', 'seed_rate', 'Spacing values must be greater than zero.'),
        ('case14', 'seed_rate', 'Germination percentage must be between 0 and 100.'),
        ('case15', 'spray_dilution', 'Tank volume must be a valid number.'),
        ('case16', 'spray_dilution', None),
        ('case17', 'gross_margin', 'Yield cannot be negative.'),
        ('case18', 'gross_margin', "Cost amount for 'a' cannot be negative."),
        ('case19', 'gross_margin', 'Each input cost must have a label and an amount.'),
        ('case20', 'weather', "Unknown function name 'weather'."),
    ]),
    "tool_results": (["id", "function", "error_message", "result", "source_ids"], [
        ('case01', 'fertiliser_rate', None, '{"n_kg":120.0,"p2o5_kg":60.0,"k2o_kg":60.0,"n_open":0.0,"p2o5_open":0.0,"k2o_open":0.0,"applications":[{"timing":"basal (at planting)","product_name":"NPK 15-15-15","product_kg":400.0,"bags":8,"bags_exact":8.0},{"timing":"top-dress (6 WAP)","product_name":"Urea","product_kg":130.43,"bags":3,"bags_exact":2.608695652173913}],"matched_exactly":true}', 'naerls_maize_2021_p14'),
        ('case02', 'seed_rate', None, '{"population":53333.333333333336,"seed_kg":15.69}', 'naerls_maize_2021_p14'),
        ('case03', 'spray_dilution', None, '{"amount":300.0,"unit":"ml","interval_days":30,"match_kind":"generic"}', 'nafdac_agrochemicals_2020'),
        ('case04', 'gross_margin', None, '{"revenue":750000.0,"total_cost":135001.0,"margin":614999.0}', ''),
        ('case05', None, 'I cannot do that.', None, ''),
        ('case06', None, None, None, ''),
        ('case07', 'fertiliser_rate', "The crop 'okra' is not supported. Supported crops are: cassava, cowpea, maize, rice, tomato, yam.", None, ''),
        ('case08', 'fertiliser_rate', 'I need the crop, area in hectares, and the agro-ecological zone to calculate the fertilizer rate.', None, ''),
        ('case09', 'fertiliser_rate', "No fertilizer recommendation found for crop 'maize' in zone 'Nowhere'", None, ''),
        ('case10', 'seed_rate', 'Area must be greater than zero.', None, ''),
        ('case11', 'seed_rate', 'Spacing must be a list of two positive numbers (e.g. [75, 25]).', None, ''),
        ('case12', 'seed_rate', 'Spacing must contain valid numbers.', None, ''),
        ('case13', 'seed_rate', 'Spacing values must be greater than zero.', None, ''),
        ('case14', 'seed_rate', 'Germination percentage must be between 0 and 100.', None, ''),
        ('case15', 'spray_dilution', 'Tank volume must be a valid number.', None, ''),
        ('case16', 'spray_dilution', "No agrochemical record found for product 'Nothing'", None, ''),
        ('case17', 'gross_margin', 'Yield cannot be negative.', None, ''),
        ('case18', 'gross_margin', "Cost amount for 'a' cannot be negative.", None, ''),
        ('case19', 'gross_margin', 'Each input cost must have a label and an amount.', None, ''),
        ('case20', 'weather', "Unknown function name 'weather'.", None, ''),
    ]),
    "parse_tool_call": (["id", "function", "error", "crop"], [
        ('case01', 'fertiliser_rate', None, ' Maize '),
        ('case02', 'seed_rate', None, 'maize'),
        ('case03', 'spray_dilution', None, None),
        ('case04', 'gross_margin', None, None),
        ('case05', None, 'I cannot do that.', None),
        ('case07', 'fertiliser_rate', None, 'okra'),
        ('case08', 'fertiliser_rate', None, 'maize'),
        ('case09', 'fertiliser_rate', None, 'maize'),
        ('case10', 'seed_rate', None, 'maize'),
        ('case11', 'seed_rate', None, 'maize'),
        ('case12', 'seed_rate', None, 'maize'),
        ('case13', 'seed_rate', None, 'maize'),
        ('case14', 'seed_rate', None, 'maize'),
        ('case15', 'spray_dilution', None, None),
        ('case16', 'spray_dilution', None, None),
        ('case17', 'gross_margin', None, None),
        ('case18', 'gross_margin', None, None),
        ('case19', 'gross_margin', None, None),
        ('case20', 'weather', None, None),
    ]),
}
