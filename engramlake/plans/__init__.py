from engramlake.plans import data_quality, knowledge_queries, scoped_queries, search_queries, store_queries, stream_queries

REGISTERED = [data_quality, store_queries, knowledge_queries, search_queries, scoped_queries, stream_queries]
