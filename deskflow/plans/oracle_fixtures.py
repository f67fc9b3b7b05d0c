"""DuckDB text of the derived input views (FIXTURES.md part 2).

Every oracle query starts with this WITH-list, so the oracle builds its inputs
from the same driver tables as the Spark views in ``sources/fixtures.py``.
"""

FIXTURES_SQL = """
WITH phrases(idx, category, intent, phrase) AS (VALUES
 (0,'PAYMENT','payment_issue','The bank card was charged twice for one invoice payment'),
 (1,'ACCOUNT','recover_password','I forgot my password and the login page rejects me'),
 (2,'ORDER','track_order','Where is the order for delivery on Monday'),
 (3,'DELIVERY','delivery_period','The courier left a damaged package at the door'),
 (4,'REFUND','get_refund','I want my money back for the return'),
 (5,'SUBSCRIPTION','newsletter_subscription','Please downgrade the membership plan'),
 (6,'CONTACT','contact_human_agent','Nobody responded to the previous ticket'),
 (7,'FEEDBACK','review','Lovely shop, a missing feature is dark colours'),
 (8,'CANCEL','check_cancellation_fee','What does it cost to cancel before the end of May'),
 (9,'INVOICE','get_invoice','Send the billing statement for March'),
 (10,'SHIPPING','change_shipping_address','The shipping label shows the wrong address'),
 (11,'ACCOUNT','edit_account','The app crashes when I edit my profile'),
 (12,'PAYMENT','payment_issue','A timeout appears on the payment screen'),
 (13,'ACCOUNT','registration_problems','The otp for verification never arrives'),
 (14,'ORDER','change_order','The coupon gives no discount at checkout'),
 (15,'ORDER','place_order','Is the blue lamp back in stock'),
 (16,'CONTACT','complaint','Service unavailable, the website is not loading'),
 (17,'ACCOUNT','delete_account','Somebody hacked me, this looks like fraud'),
 (18,'PAYMENT','check_payment_methods','zxq wvut blorf 12345'),
 (19,'REFUND','track_refund','Still waiting for the reimbursement'),
 (20,'CONTACT','contact_customer_service','hello there'),
 (21,'FEEDBACK','complaint','Bad quality, terrible product and a ridiculous offer'),
 (22,'DELIVERY','delivery_options','Late again'),
 (23,'INVOICE','check_invoice','hi')),
tones(idx, tone) AS (VALUES
 (0,''),(1,' Thank you, great and kind help!'),(2,' This is urgent, fix it immediately, asap!!'),
 (3,' I am angry and frustrated.'),(4,' Can you help me right now?'),(5,' It is not working.'),
 (6,' I cannot accept this error!'),(7,' Please advise.'),(8,'   '),(9,' Excellent, I am happy and satisfied!')),
tickets AS (
 SELECT e.event_id AS ticket_id,
  CASE WHEN CAST((e.event_id - e.event_id % 240) / 240 AS BIGINT) % 3 = 0 THEN p.phrase || t.tone
       ELSE p.phrase || t.tone || ' ref ' || CAST(e.event_id AS VARCHAR(20)) END AS description,
  'User ' || CAST(e.user_id AS VARCHAR(20)) AS customer_name,
  CASE e.user_id % 3 WHEN 0 THEN 'Chatbot' WHEN 1 THEN 'Email' ELSE 'Seed' END AS channel,
  CASE e.user_id % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'east' ELSE 'west' END AS region,
  CASE e.event_type WHEN 'view' THEN 'Open' WHEN 'click' THEN 'In Progress' WHEN 'purchase' THEN 'Resolved'
       WHEN 'error' THEN 'Triage' ELSE 'Escalated' END AS status,
  p.category AS true_category, p.intent AS true_intent,
  CASE WHEN e.event_id % 53 = 0 THEN NULL ELSE p.category END AS predicted_category,
  CASE e.event_id % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Critical' ELSE 'Low' END AS predicted_priority,
  CAST((e.event_id * 37) % 1000 AS DOUBLE) / 1000 AS confidence_score,
  CASE WHEN (e.event_id * 37) % 1000 >= 800 THEN 'Low' WHEN (e.event_id * 37) % 1000 < 600 THEN 'High'
       ELSE 'Medium' END AS risk_level,
  CASE WHEN (e.event_id * 37) % 1000 < 600 THEN 1 ELSE 0 END AS is_triage,
  CASE WHEN e.event_id % 11 = 0 THEN '' WHEN e.event_id % 11 = 1 THEN NULL ELSE 'noted' END AS resolution_notes,
  e.ts AS created_at,
  CASE WHEN e.event_id % 4 = 0 THEN e.ts ELSE (e.ts + to_hours(CAST(e.event_id % 72 AS INT))) END AS updated_at,
  CASE WHEN e.event_type = 'purchase' THEN (e.ts + to_hours(CAST(e.event_id % 72 AS INT))) END AS resolved_at
 FROM events e
 JOIN phrases p ON p.idx = e.event_id % 24
 JOIN tones t ON t.idx = CAST((e.event_id - e.event_id % 24) / 24 AS BIGINT) % 10),
triage AS (
 SELECT ticket_id AS triage_id, ticket_id, 'High risk score' AS reason, true_category AS original_prediction,
  CASE ticket_id % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Resolved' ELSE 'Escalated' END AS status, created_at
 FROM tickets WHERE is_triage = 1),
steps(seq) AS (VALUES (1),(2),(3)),
actions AS (
 SELECT t.ticket_id, s.seq,
  CASE (t.ticket_id + s.seq) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reassign' ELSE 'escalate' END AS action,
  CASE WHEN (t.ticket_id + s.seq) % 3 = 1 THEN 'ACCOUNT' END AS new_department,
  CASE WHEN t.ticket_id % 2 = 0 THEN 'agent' || CAST(s.seq AS VARCHAR(20)) END AS assigned_to,
  (t.created_at + to_hours(CAST(s.seq AS INT))) AS acted_at
 FROM triage t JOIN steps s ON s.seq <= 1 + t.ticket_id % 3),
patches AS (
 SELECT ticket_id, CASE ticket_id % 15 WHEN 0 THEN 'Resolved' WHEN 5 THEN '' END AS status,
  CASE WHEN ticket_id % 10 = 0 THEN 'ORDER' END AS assigned_department,
  (created_at + to_hours(100)) AS patched_at
 FROM tickets WHERE ticket_id % 5 = 0),
labels11(k, label) AS (VALUES (0,'ACCOUNT'),(1,'CANCEL'),(2,'CONTACT'),(3,'DELIVERY'),(4,'FEEDBACK'),
 (5,'INVOICE'),(6,'ORDER'),(7,'PAYMENT'),(8,'REFUND'),(9,'SHIPPING'),(10,'SUBSCRIPTION')),
weights AS (
 SELECT t.ticket_id, l.label, 1 + (t.ticket_id * (l.k + 3)) % 97
   + CASE WHEN t.ticket_id % 11 = l.k THEN ((t.ticket_id * 37) % 1000) * 6 ELSE 0 END AS w
 FROM tickets t CROSS JOIN labels11 l),
probabilities AS (
 SELECT ticket_id, label, CAST(w AS DOUBLE) / SUM(w) OVER (PARTITION BY ticket_id) AS p FROM weights),
corpus AS (
 SELECT ticket_id AS id, description AS instruction, true_intent AS intent, true_category AS category FROM tickets)
"""


def with_fixtures(*ctes: str) -> str:
    """``WITH <fixture views>, <ctes...>`` ready for a final SELECT."""
    extra = "".join(",\n" + c for c in ctes)
    return FIXTURES_SQL.strip() + extra + "\n"
