"""Schemas of the nine retail source tables, as Spark DDL. Names and types are fixed by the source system."""

SCHEMAS = {
    "customer": "customer_id string, customer_unique_id string, customer_zip_code_prefix int, customer_city string, customer_state string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, geolocation_city string, geolocation_state string",
    "order_item": "order_id string, order_item_id int, product_id string, seller_id string, shipping_limit_date timestamp_ntz, price decimal(18,2), freight_value decimal(18,2)",
    "payment": "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(18,2)",
    "order_review": "review_id string, order_id string, review_score int, review_comment_title string, review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz",
    "order": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    "product": "product_id string, product_category_name string, product_name_lenght int, product_description_lenght int, product_photos_qty int, product_weight_g int, product_length_cm int, product_height_cm int, product_width_cm int",
    "seller": "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string",
    "product_category": "product_category_name string, product_category_name_english string",
}
