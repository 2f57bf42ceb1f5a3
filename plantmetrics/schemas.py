"""Fixed schemas (DDL) of the input tables; codes stay strings so leading zeros survive."""

from __future__ import annotations

PRODUCTION_LOG = (
    "date date, shift int, line_id string, brand string, model_name string, planned_qty int, actual_qty int,"
    " defect_qty int, downtime_minutes int, changeover_minutes int, operator_count int, machine_id string,"
    " oee_score double"
)
DEFECT_LOG = (
    "date date, line_id string, brand string, model_name string, inspector_id string, defect_type string,"
    " severity string, action string, detection_point string, inspection_time_seconds int, photo_taken boolean"
)
INVENTORY = (
    "material_id string, material_name string, category string, supplier string, country_origin string,"
    " current_stock int, reorder_point int, lead_time_days int, unit_price_eur double, last_order_date date,"
    " consumption_rate_daily int, hs_code string"
)
PURCHASE_ORDERS = (
    "po_number string, date date, supplier string, material_id string, qty_ordered int, qty_received int,"
    " unit_price double, total_eur double, expected_delivery date, actual_delivery date, delay_days int,"
    " quality_score int"
)
PRODUCTS_DPP = (
    "product_id string, product_name string, brand string, hs_code_6digit string, hs_code_10digit string,"
    " country_origin string, materials_composition string, weight_grams int, carbon_footprint_kg double,"
    " recyclability_score int, hazardous_substances string, factory_id string, production_date date,"
    " batch_number string"
)
HS_CLASSIFICATIONS = (
    "product_description string, correct_hs_code string, country_destination string, duty_rate_percent double,"
    " preferential_rate double, fta_applicable string, special_requirements string"
)
QUERY_LOG = (
    "timestamp timestamp, question string, answer_length int, top_source string, confidence double,"
    " response_time_ms double"
)
REALTIME_LOG = (
    "timestamp timestamp, image string, prediction string, confidence double, processing_time_ms double,"
    " actual_label string, correct boolean"
)
