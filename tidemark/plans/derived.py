"""Catalog, log and workflow inputs derived from the base tables.

The reference keeps these as application state. Here each is one row-wise SELECT over a base table
(no shuffle), so it grows with the data. The text is plain SQL that Spark and the oracle both run.

projects <- customer, sources <- orders, tables <- part, columns <- events, dictionary <- customer,
search log, SQL log and workflow log <- events, questions and sessions <- orders.
"""

DERIVED = {
    "cat_projects": """
        SELECT c_custkey AS project_id, c_name AS name,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'active'
                    WHEN 'FURNITURE' THEN 'archived' WHEN 'HOUSEHOLD' THEN 'draft' END AS status,
               concat('owner_', cast(c_nationkey AS varchar(10))) AS owner
        FROM {customer}""",
    "cat_sources": """
        SELECT o_orderkey AS source_id, o_custkey AS project_id,
               concat('export ', cast(o_orderkey AS varchar(20)), '.csv') AS name,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'database' ELSE 'file' END AS type,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed'
                    ELSE 'pending' END AS ingest_status,
               o_orderdate AS created_at
        FROM {orders}""",
    "cat_tables": """
        SELECT p_partkey AS table_id, p_partkey AS source_id,
               concat(replace(p_name, ' ', '_'), '_',
                      CASE p_size % 8 WHEN 0 THEN 'orders' WHEN 1 THEN 'customers'
                           WHEN 2 THEN 'payments' WHEN 3 THEN 'inventory' WHEN 4 THEN 'employees'
                           WHEN 5 THEN 'campaigns' WHEN 6 THEN 'shipments' ELSE 'sales' END) AS name,
               CASE WHEN p_size % 2 = 0 THEN concat('The ', p_name) END AS display_name,
               CASE WHEN p_size % 3 <> 0
                    THEN concat(p_type, ' goods with the ', p_name, ' of size ',
                                cast(p_size AS varchar(10))) END AS description,
               CASE WHEN p_size % 5 <> 0 THEN lower(replace(p_brand, '#', '_')) END AS schema_name,
               CASE WHEN p_size % 10 = 0 THEN 'view' ELSE 'table' END AS table_type,
               cast(p_size AS bigint) * 1000 AS row_count
        FROM {part}""",
    "cat_columns": """
        SELECT event_id AS column_id, user_id AS table_id, event_id AS pos,
               concat(CASE WHEN event_id % 35 = 4 THEN '' ELSE concat(event_type, '_') END,
                      CASE event_id % 12 WHEN 0 THEN 'customer_id' WHEN 1 THEN 'order_date'
                           WHEN 2 THEN 'total_amount' WHEN 3 THEN 'item_count' WHEN 4 THEN 'status'
                           WHEN 5 THEN 'email' WHEN 6 THEN 'phone_number' WHEN 7 THEN 'zip_code'
                           WHEN 8 THEN 'description' WHEN 9 THEN 'created_at'
                           WHEN 10 THEN 'unit_price' ELSE 'region' END) AS name,
               CASE WHEN event_id % 4 = 1 THEN concat('Column ', event_type) END AS display_name,
               CASE WHEN event_id % 3 = 1
                    THEN concat('Holds the ', event_type, ' reading for a user') END AS description,
               CASE event_id % 4 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'VARCHAR' WHEN 2 THEN 'DOUBLE'
                    ELSE 'TIMESTAMP' END AS data_type,
               event_id % 3 = 0 AS is_nullable, event_id % 12 = 0 AS is_primary_key,
               event_id % 12 = 3 AS is_foreign_key,
               event_id % 12 IN (5, 6, 7) AS pii_flag,
               CASE WHEN event_id % 5 <> 0 THEN
                    CASE event_id % 3 WHEN 0 THEN 'identifier' WHEN 1 THEN 'temporal'
                         ELSE 'attribute' END END AS business_category,
               CASE WHEN event_id % 7 <> 0
                    THEN split(concat(event_type, ',', props, ',v', cast(event_id AS varchar(20)),
                               ',x,y,z'), ',') END AS sample_values
        FROM {events}""",
    "cat_entries": """
        SELECT c_custkey AS entry_id, cast(c_nationkey AS bigint) AS project_id,
               concat(CASE c_custkey % 6 WHEN 0 THEN 'Customer' WHEN 1 THEN 'Net Revenue'
                           WHEN 2 THEN 'Order Status' WHEN 3 THEN 'Unit Price'
                           WHEN 4 THEN 'region' ELSE 'Item Count' END,
                      CASE WHEN c_custkey % 4 = 0 THEN ''
                           ELSE concat(' ', lower(c_mktsegment)) END) AS term,
               concat('Meaning of ', lower(c_mktsegment), ' for ', c_name,
                      CASE WHEN c_custkey % 9 = 0
                           THEN concat('. ', repeat('It is kept for audits. ', 12)) ELSE '' END)
                   AS definition,
               CASE WHEN c_custkey % 5 = 0 THEN concat('Seen in ', lower(c_mktsegment)) END AS context,
               CASE c_custkey % 5 WHEN 0 THEN 'business_term' WHEN 1 THEN 'metric'
                    WHEN 2 THEN 'entity' WHEN 3 THEN 'technical_term' ELSE 'domain' END AS category,
               CASE c_custkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved'
                    WHEN 2 THEN 'pending_review' ELSE 'archived' END AS status,
               CASE WHEN c_custkey % 3 <> 0
                    THEN split(concat(lower(c_mktsegment), ',buyer'), ',') END AS synonyms,
               CASE WHEN c_custkey % 2 = 0 THEN split('cust,acc', ',') END AS abbreviations,
               CASE WHEN c_custkey % 4 <> 1
                    THEN split(concat('sales,', lower(c_mktsegment)), ',') END AS domain_tags,
               CASE WHEN c_custkey % 6 <> 5 THEN lower(c_mktsegment) END AS domain,
               c_acctbal < 2000 AS is_auto_generated, c_custkey % 11 AS usage_count
        FROM {customer}""",
    "search_log": """
        SELECT event_id AS log_id, user_id AS project_id, concat(event_type, ' ', props) AS query,
               event_type AS query_type, value AS search_time_ms,
               event_id % 17 AS results_count, ts AS created_at
        FROM {events}""",
    "sql_log": """
        SELECT event_id AS stmt_id, user_id,
               CASE event_id % 10
                 WHEN 0 THEN concat('SELECT * FROM ', event_type, '_log WHERE user_id = ', cast(user_id AS varchar(20)))
                 WHEN 1 THEN concat('select created_at from ', event_type, '_log order by created_at limit 5;')
                 WHEN 2 THEN concat('DROP TABLE ', event_type, '_log')
                 WHEN 3 THEN concat('-- cleanup', chr(10), 'DELETE FROM events WHERE event_id = ', cast(event_id AS varchar(20)), ';')
                 WHEN 4 THEN concat('WITH t AS (SELECT 1) SELECT count(*) FROM events e JOIN orders o ON e.id = o.id -- ', event_type)
                 WHEN 5 THEN concat('  ', chr(10), 'SELECT value,', chr(10), '   ts FROM events', chr(10), 'WHERE event_type = ''', event_type, '''')
                 WHEN 6 THEN concat('EXPLAIN SELECT * FROM lineitem /* ', event_type, ' */ WHERE l_orderkey > 3')
                 WHEN 7 THEN concat('INSERT INTO ', event_type, '_log SELECT * FROM events')
                 WHEN 8 THEN ''
                 ELSE concat('SELECT c_name FROM customer, nation WHERE c_nationkey = ', cast(event_id % 25 AS varchar(20)))
               END AS sql_text
        FROM {events}""",
    "questions": """
        SELECT o_orderkey AS question_id, o_custkey AS session_id,
               CASE o_orderkey % 9
                 WHEN 0 THEN concat('Show me all customers with ', lower(o_orderpriority), ' priority')
                 WHEN 1 THEN 'How many view_order_date values and click_total_amount rows?'
                 WHEN 2 THEN concat('What is the growth of purchase_item_count over time and by ', o_orderstatus)
                 WHEN 3 THEN 'Top 10 suppliers by revenue'
                 WHEN 4 THEN concat('join error_status with signup_email group by region having more than ', cast(o_custkey AS varchar(20)))
                 WHEN 5 THEN 'list the blue_bolt_orders where the price and the cost or the tax are high and when the item is old or new, and also which ones were sent and paid in the same week by the same buyer'
                 WHEN 6 THEN concat('compare sales versus last year for customer ', cast(o_custkey AS varchar(20)))
                 WHEN 7 THEN 'Which Customer has the best Unit Price?'
                 ELSE '' END AS question
        FROM {orders}""",
    "entities_raw": """
        SELECT o_orderkey AS entity_id, o_custkey AS session_id,
               CASE o_orderkey % 8 WHEN 0 THEN 'customer' WHEN 1 THEN 'view order date'
                    WHEN 2 THEN 'blue bolt orders' WHEN 3 THEN 'unit price'
                    WHEN 4 THEN 'purchase_item_count' WHEN 5 THEN 'Net Revenue'
                    WHEN 6 THEN lower(o_orderpriority) ELSE NULL END AS entity,
               CASE o_orderkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'column' WHEN 2 THEN 'value'
                    WHEN 3 THEN 'business_term' ELSE NULL END AS entity_type,
               CASE o_orderkey % 7 WHEN 0 THEN '0.95' WHEN 1 THEN '0.4' WHEN 2 THEN 'high'
                    WHEN 3 THEN NULL WHEN 4 THEN '0.75' WHEN 5 THEN '1.0' ELSE '0.5' END AS confidence
        FROM {orders}""",
    "cat_embeddings": """
        SELECT vec_id AS embedding_id, cast(label AS bigint) AS project_id,
               CASE vec_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'column'
                    ELSE 'dictionary_entry' END AS object_type,
               vec_id AS object_id,
               CASE WHEN vec_id % 5 = 0 THEN 'hash-64' ELSE 'mini-64' END AS model_name,
               embedding AS vector
        FROM {embeddings}""",
    "cat_indexes": """
        SELECT s_suppkey AS index_id, cast(s_nationkey AS bigint) AS project_id, s_name AS name,
               CASE s_suppkey % 3 WHEN 0 THEN 'faiss' WHEN 1 THEN 'tfidf' ELSE 'bm25' END AS type,
               CASE s_suppkey % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'error' ELSE 'ready' END AS status,
               s_suppkey * 10 AS total_objects, s_suppkey * 7 AS indexed_objects
        FROM {supplier}""",
    "workflow_log": """
        SELECT event_id, user_id AS entry_id, ts,
               CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'approve'
                    WHEN 'error' THEN 'reject' WHEN 'click' THEN 'use' ELSE 'edit' END AS action
        FROM {events}""",
    "sessions": """
        SELECT o_orderkey AS session_id, o_custkey AS project_id,
               CASE o_orderkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'entity_mapping'
                    WHEN 2 THEN 'cancelled' ELSE 'completed' END AS status,
               o_orderdate AS created_at,
               CASE WHEN o_orderkey % 5 IN (3, 4) THEN '[1]' END AS sql_result,
               CASE WHEN o_orderkey % 10 = 3 THEN 'good' END AS user_feedback,
               CASE WHEN o_orderkey % 6 <> 0 THEN round(o_totalprice / 1000, 2) END AS step_extract,
               round(o_totalprice / 2000, 2) AS step_map
        FROM {orders}""",
    "feedback": """
        SELECT event_id AS feedback_id, user_id AS session_id,
               CASE event_type WHEN 'signup' THEN 'positive' WHEN 'purchase' THEN 'suggestion'
                    WHEN 'error' THEN 'negative' ELSE 'correction' END AS feedback_type,
               CASE event_id % 4 WHEN 0 THEN 'entities' WHEN 1 THEN 'mappings' WHEN 2 THEN 'sql'
                    ELSE 'results' END AS step,
               CASE WHEN event_id % 6 <> 0 THEN event_id % 5 + 1 END AS rating,
               ts AS created_at
        FROM {events}""",
}
